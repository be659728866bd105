import datetime as dt
import hashlib
import random

import pytest
from conftest import rows

from stratalith.operators import cdc
from stratalith.plans.cdc import P1_SQL
from stratalith.sources.ledger import MUTATION, CorruptJournal, Ledger, lookup, read_journal, read_snapshot, scan
from stratalith.storage import new_path

SNAPSHOT = "scope_kind string, scope_id string, collection string, id string, mutation_seq bigint, value_json string, bucket int"
LINE = "ledger_version int, mutation_seq bigint, scope_kind string, scope_id string, collection string, op string, id string, value_json string, logged_at timestamp_ntz, __cdc_bucket int"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_against_sql_with_clashing_columns(spark):
    import duckdb
    import pandas as pd

    r = random.Random(5)
    ops = ["insert", " Update", "UPSERT ", "delete", "Delete", "noop", None, ""]
    journal = [(r.choice([2, 2, 2, 1, None]), r.choice([None, *range(40)]), r.choice(["session", None, "workspace"]), r.choice(["a", "b", None]), r.choice(["c", " ", None, "d"]), r.choice(ops), r.choice(["x", "y", "z", "", None]), r.choice([None, "{}"]), r.choice([at(i) for i in range(50)]), 1) for _ in range(600)]
    snapshot = [(kind, "a", "c", key, 7, "{}", 0) for kind in ("session", "workspace") for key in "xy"]
    got = rows(cdc.rebuild_ledger(spark.createDataFrame(snapshot, SNAPSHOT), spark.createDataFrame(journal, LINE), buckets=5), "scope_kind", "scope_id", "collection", "id", "mutation_seq")
    con = duckdb.connect()
    frame = pd.DataFrame(journal, columns=[c.split()[0] for c in LINE.split(", ")]).astype({"mutation_seq": "Int64", "ledger_version": "Int64"})
    con.register("ledger_journal", frame)
    con.register("ledger_snapshot", pd.DataFrame(snapshot, columns=[c.split()[0] for c in SNAPSHOT.split(", ")]))
    want = con.execute(P1_SQL).fetchall()
    assert got == sorted(want, key=str) and got


def test_only_touched_buckets_are_rewritten_and_batches_apply_once(spark):
    base = spark.createDataFrame([("session", "s", "c", f"k{i}", 1, "{}", 0) for i in range(200)], SNAPSHOT)
    table = cdc.BucketedTable.create(cdc.ledger_base(base), new_path(spark, "t"), cdc.LEDGER, 16)
    before = table.manifest()
    line = [(2, 9, None, "s", "c", "delete", "k3", None, at(1), 0)]
    feed = cdc.ledger_changes(spark.createDataFrame(line, LINE))
    assert table.apply(feed, batch=1) == 2 and table.apply(feed, batch=1) == 2
    after = table.manifest()
    assert sum(before["files"].get(b) != f for b, f in after["files"].items()) == 1
    assert table.rows().count() == 199 and table.rows(version=before["version"]).count() == 200
    late = cdc.ledger_changes(spark.createDataFrame([(2, 5, None, "s", "c", "upsert", "k3", "{}", at(9), 0)], LINE))
    table.apply(late)
    assert table.rows().count() == 199  # an older write doesn't bring a deleted record back
    with pytest.raises(RuntimeError):
        table._commit(after)
    assert table.vacuum() >= 0 and table.rows().count() == 199


def test_base_is_not_shuffled_and_buckets_follow_bytes(spark):
    base = spark.createDataFrame([("session", None if i % 5 == 0 else "s", "c", f"k{i}", i, hashlib.sha256(str(i).encode()).hexdigest(), 0) for i in range(3000)], SNAPSHOT)
    table = cdc.BucketedTable.create(cdc.ledger_base(base), new_path(spark, "t"), cdc.LEDGER, bucket_bytes=8000)
    first = table.manifest()
    assert first["buckets"] > cdc.LEAST_BUCKETS and first["last"] == 2999 and sum(map(len, first["files"].values())) == len(first["files"])
    merged = cdc.latest(table._scan(first).unionByName(cdc.ledger_base(base).repartition(first["buckets"], *cdc.LEDGER.keys)), cdc.LEDGER)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # that of the feed
    more = spark.range(3000, 12000).selectExpr("2 AS ledger_version", "id AS mutation_seq", "'session' AS scope_kind", "'s' AS scope_id", "'c' AS collection", "'upsert' AS op", "concat('k', id) AS id", "sha2(cast(id as string), 256) AS value_json", "timestamp_ntz'2024-01-01' AS logged_at")
    table.apply(cdc.ledger_changes(more))
    assert table.manifest()["buckets"] > first["buckets"] and table.rows().count() == 12000 and table.rows(version=first["version"]).count() == 3000
    again = table.manifest()
    table.apply(cdc.ledger_changes(more))
    assert table.manifest()["buckets"] == again["buckets"] and table.rows().distinct().count() == 12000


def test_of_two_writers_one_commits(spark):
    from concurrent.futures import ThreadPoolExecutor

    path = new_path(spark, "t")
    table = cdc.BucketedTable.create(cdc.ledger_base(spark.createDataFrame([], SNAPSHOT)), path, cdc.LEDGER)
    manifest = table.manifest() | {"version": 1}

    def write(i):
        try:
            cdc.BucketedTable(spark, path, cdc.LEDGER)._commit(manifest | {"last": i})
            return i
        except RuntimeError:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [x for x in pool.map(write, range(8)) if x is not None]
    assert len(won) == 1 and table.manifest()["last"] == won[0]


def test_intermediate_tables_need_a_shared_folder():
    from stratalith import storage

    assert [storage.needs_shared(m) for m in ("local", "local[8]", "local[*]", "local-cluster[2,1,1024]", "spark://h:7077", "yarn", "k8s://h")] == [False] * 3 + [True] * 4

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session())


def test_empty_tables(spark):
    out = cdc.rebuild_ledger(spark.createDataFrame([], SNAPSHOT), spark.createDataFrame([], LINE))
    assert out.count() == 0


def test_hot_key(spark):
    lines = spark.range(20_000).selectExpr("2 AS ledger_version", "id AS mutation_seq", "'session' AS scope_kind", "'s' AS scope_id", "'c' AS collection", "'upsert' AS op", "if(id % 3 = 0, 'hot', cast(id % 50 as string)) AS id", "'{}' AS value_json", "timestamp_ntz'2024-01-01' AS logged_at")
    out = cdc.rebuild_ledger(spark.createDataFrame([], SNAPSHOT), lines)
    assert out.count() == 51 and out.filter("id = 'hot'").collect()[0]["mutation_seq"] == 19_998


def test_journal_and_snapshot_files(spark, tmp_path):
    good = '{"version":2,"sequence":%d,"scopeKind":"session","scopeId":"a","collection":"c","op":"upsert","id":"x","value":{"n":%d}}\n'
    path = tmp_path / "journal.jsonl"
    path.write_text(good % (1, 1) + good % (2, 2) + '{"version":2,"sequ')
    got = read_journal(spark, str(path))
    assert [r["mutation_seq"] for r in got.orderBy("mutation_seq").collect()] == [1, 2]
    path.write_text(good % (1, 1) + "{broken\n" + good % (2, 2))
    with pytest.raises(CorruptJournal):
        read_journal(spark, str(path))
    snap = tmp_path / "snapshot.json"
    snap.write_text('{"version":2,"collections":{"c":[{"scopeKind":"session","scopeId":"a","id":"x"}],"d":[]}}')
    assert rows(read_snapshot(spark, str(snap)), "scope_kind", "collection", "id") == [("session", "c", "x")]
    snap.write_text('{"version":1,"collections":{}}')
    with pytest.raises(ValueError):
        read_snapshot(spark, str(snap))


def test_ledger(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", buckets=4)
    shape = "scope_kind string, scope_id string, collection string, id string, value_json string"
    ledger.upsert(spark.createDataFrame([("session", "s1", "c", "x", '{"a":1}'), ("session", "s2", "c", "x", '{"a":2}'), ("session", "s1", "c", "y", '{"tombstonedAt":5}')], shape))
    assert ledger.last_sequence() == 3
    assert rows(scan(ledger.state(), "c", "session", "s1"), "id") == [("x",)]
    assert lookup(ledger.state(), "c", "y").count() == 1  # a lookup finds soft-deleted records
    ledger.delete(spark.createDataFrame([("session", "s2", "c", "x")], "scope_kind string, scope_id string, collection string, id string"))
    ledger.compact()
    assert ledger.journal().count() == 0 and ledger.state().count() == 2
    ledger.drop_scope("session", "s1")
    assert ledger.state().count() == 0
    assert MUTATION.names[0] == "ledger_version"


def test_calls_keep_their_order(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    shape = "scope_kind string, scope_id string, collection string, op string, id string, value_json string, position bigint"
    line = lambda op, id, n: ("session", "s", "c", op, id, "{}", n)
    assert ledger.mutate(spark.createDataFrame([line("upsert", "x", 5), line("delete", "x", 7), line("delete", "y", 5), line("upsert", "y", 6)], shape)) == 3
    assert rows(ledger.state(), "id") == [("y",)]
    with pytest.raises(ValueError):
        ledger.mutate(spark.createDataFrame([line("upsert", "x", 0), line("delete", "x", 0)], shape).drop("position"))
    with pytest.raises(ValueError):
        ledger.mutate(spark.createDataFrame([line("upsert", "x", None)], shape))
    assert Ledger(spark, f"file://{tmp_path}/ledger").last_sequence() == 3
    assert ledger.mutate(spark.createDataFrame([], shape)) == 3
