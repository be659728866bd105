import json

import pytest

import __spark_entry__ as entry

from stratalith import api
from stratalith.streaming import turns


def test_entry_and_names(spark):
    assert entry.entry(spark).count() >= 0
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known) and "p1_found" in known


def test_tools_have_methods():
    assert len(api.TOOLS) == 14 and all(hasattr(api.Memory, m) for m in api.TOOLS.values())


def test_memory(spark, tmp_path):
    from stratalith.sources.ledger import Ledger
    from test_layers import log
    from test_match import FACTS, TEXT, C, P, Q

    children = spark.createDataFrame([("s", p, f"{p}:c", t, None, None) for p, t in FACTS.items()], C)
    parents = spark.createDataFrame([("s", p, p, 1, True, True, False, None, t) for p, t in FACTS.items()], P)
    events = log(spark, [(1, "turn/start", 1, None, None), (2, "user/message", 1, "hello there", None)])
    memory = api.Memory(spark, Ledger(spark, f"file://{tmp_path}/l", 2), events, parents, children, planner=lambda p: 'sure: {"selectedIds": ["p1", "zz"]}')
    queries = spark.createDataFrame([(1, "s", TEXT, None, None)], Q)
    assert memory.recall(queries, 2).count() == 2
    assert memory.demote("s", 2).count() == 1 and memory.demote("s", 2).count() == 0  # a turn goes once
    assert {r["collection"]: r["live"] for r in memory.status().collect()} == {"sensoryChunks": 1, "sourceSegments": 1}
    kept = memory.open("chunk:seg-s-1:parent:001").collect()[0]
    assert kept["core_text"] == "[seq 2] user: hello there" and json.loads(kept["value_json"])["sourceRefs"] == [{"sessionId": "s", "seq": 2}]
    assert [r["text"] for r in memory.sources("seg-s-1:parent:001").collect()] == ["hello there"]
    for _ in range(2):
        memory.open("seg-s-1:parent:001", "other", "w", 4)
    assert [u["turn"] for u in json.loads(memory.open("seg-s-1:parent:001").collect()[0]["value_json"])["associations"]] == [4]
    assert {r["parent_id"] for r in memory.verify(queries, spark.createDataFrame([(1, "p2"), (1, "nobody")], "query_id bigint, parent_id string")).collect()} == {"p2"}
    verdict = memory.review({"evidence_quality": 0.7}, lambda p: '{"target": "bank", "confidence": 0.9, "evidenceQuality": 2, "importance": "x"}')
    assert verdict == {"target": "bank", "importance": 0.5, "durability": 0.5, "evidence_quality": 0.7}
    assert memory.plan("q", [{"id": "p1"}]) == ["p1"]
    assert api.call(memory, "sensory_debug_last_prompt").count() == 1
    asked = []
    memory.planner = lambda p: asked.append(p) or '{"selectedIds": ["p1"]}'
    assert memory.plan("q", [{"id": "p1"}], turn=1) == memory.plan("q", [{"id": "p1"}], turn=1) == ["p1"] and len(asked) == 1
    memory.freeze("s")
    assert [r["session_id"] for r in memory.frozen().collect()] == ["s"]
    memory.unfreeze("s")
    assert memory.frozen().count() == 0
    memory.mode = "retrieval-only"
    with pytest.raises(PermissionError):
        api.call(memory, "memory_forget", target="x")
    memory.drop_session("s")
    assert memory.status().count() == 0


def test_modes_and_schemas():
    assert [t["name"] for t in api.schemas("retrieval-only")] == ["sensory_recall", "sensory_open"] and api.schemas("compression-only") == [] and len(api.schemas()) == 14
    assert api.schemas()[0]["parameters"] == {"type": "object", "properties": {"query": {"type": "string"}}, "required": ["query"], "additionalProperties": False}


def test_forget_keeps_types_and_cascades(spark, tmp_path):
    from stratalith.sources.ledger import Ledger

    ledger = Ledger(spark, f"file://{tmp_path}/l")
    none = spark.createDataFrame([], "session_id string")
    memory = api.Memory(spark, ledger, none, none, none)
    put = lambda c, rows: memory.put(spark.createDataFrame(rows, "scope_kind string, scope_id string, id string, value_json string"), c)
    put("bankChunks", [("workspace", "w", "b1", '{"coreText":"Deploy on Friday","n":3,"vector":[1,2],"tombstonedAt":null}'), ("workspace", "v", "b2", '{"coreText":"deploy on friday"}')])
    put("semipersistentRecords", [("workspace", "w", "m1", '{"bankRecordId":"b1"}'), ("workspace", "w", "m2", '{"bankRecordId":"b9"}')])
    put("semipersistentProjections", [("session", "s", "m1@s", "{}"), ("session", "s", "m2@s", "{}")])
    put("sensoryChunks", [("session", "s", "c1", '{"segmentId":"m1","coreText":"x"}'), ("session", "s", "c2", '{"segmentId":"m2","coreText":"keep me"}')])
    gone = memory.forget("deploy ON friday", workspace_id="w")
    assert {k: [r["id"] for r in v.collect()] for k, v in gone.items()} == {"bankChunks": ["b1"], "semipersistentRecords": ["m1"], "semipersistentProjections": ["m1@s"], "sensoryChunks": ["c1"]}
    left = {r["id"]: r["value_json"] for r in ledger.state().collect()}
    assert set(left) == {"b1", "b2", "m2", "m2@s", "c2"}
    value = json.loads(left["b1"])
    assert value["n"] == 3 and value["vector"] == [1, 2] and value["tombstonedAt"] > 0
    assert [r["id"] for r in memory.forget("keep me", "session", session_id="s")["sensoryChunks"].collect()] == ["c2"]
    assert memory._records("sensoryChunks").count() == 0


def test_standalone_memory(spark, tmp_path):
    from stratalith.standalone import StandaloneMemory

    memory = StandaloneMemory(spark, f"file://{tmp_path}/m", "s1", max_tokens=400)
    assert memory.ready()["ready"]
    first = memory.manage("The gateway port is 8443 and it stays closed on Sundays.")
    assert first["content"] == ["The gateway port is 8443 and it stays closed on Sundays."] and not first["was_compacted"]
    second = memory.manage("What else? The backup runs at nine.", question="Which port does the gateway use?")
    assert second["retrieved"] == ["manual-s1-1:parent:001"] and second["content"][0].startswith("The gateway port") and second["tokens"] <= 400
    found = memory.retrieve("Which port is closed on Sundays?", 200)
    assert "port is 8443" in found["notes"]
    checked = memory.verify_plan([found["selected"][0], "unknown"], budget=5)
    assert checked["verified"] and checked["notes"] == ""
    stats = memory.stats()
    assert stats["parents"] == 1 and stats["children"] == 1
    assert memory.close() == {"closed": True, "already_closed": False} and memory.close()["already_closed"]
    with pytest.raises(RuntimeError):
        memory.stats()


def test_stream_of_turns(spark, tmp_path):
    from test_layers import log

    events = log(spark, [(1, "turn/start", 1, None, None), (2, "user/message", 1, "x" * 400, None), (3, "turn/end", 1, None, None), (4, "turn/start", 2, None, None), (5, "user/message", 2, "y" * 40, None), (6, "turn/start", 3, None, None)])
    events.write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", turns.ROCKSDB)
    out = turns.turns(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), 90, 50, checkpoint_tokens=20)
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("turn").collect()
    assert [(r["turn"], r["tokens"], r["evicted"], r["in_surface"]) for r in got] == [(1, 100, True, 20), (2, 10, False, 30)]
