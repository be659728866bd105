import pytest
from conftest import rows
from pyspark.sql import functions as F

from stratalith.operators import match

Q = "query_id bigint, scope string, text string, vector array<float>, vector_model string"
C = "scope string, parent_id string, child_id string, text string, vector array<float>, vector_model string"
P = "scope string, parent_id string, document_id string, turn bigint, eligible boolean, source_valid boolean, conflict boolean, updated_at timestamp_ntz, view string"
FACTS = {"p1": "The gateway listens on port 8443 behind the proxy.", "p2": "Marta owns the billing service and its invoices.", "p3": "Nightly backup files are stored in the cellar archive."}
TEXT = "Which port does the gateway use; who owns the billing service; where are backup files stored?"


def retrieval(spark, eligible=True, scope="s", extra=()):
    facts = FACTS | dict(extra)
    children = spark.createDataFrame([("s", p, f"{p}:c", t, None, None) for p, t in facts.items()], C)
    parents = spark.createDataFrame([("s", p, p, 1, eligible, True, False, None, t) for p, t in facts.items()], P)
    return match.Retrieval(spark.createDataFrame([(1, scope, TEXT, None, None)], Q), children, parents)


def test_every_clause_is_covered(spark):
    r = retrieval(spark).result.collect()[0]
    assert r["sufficient"] and set(r["selected"]) == set(FACTS) and r["uncovered"] == []


def test_other_scope_and_ineligible_parents(spark):
    assert retrieval(spark, scope="other").result.collect()[0]["selected"] == []
    r = retrieval(spark, eligible=False).result.collect()[0]
    assert r["selected"] == [] and r["needs_planner"] and "uncovered-subqueries" in r["reasons"]


def test_fallback_asks_the_bank(spark):
    queries = spark.createDataFrame([(1, "s", TEXT, None, None)], Q)
    side = lambda names: (spark.createDataFrame([("s", p, f"{p}:c", FACTS[p], None, None) for p in names], C), spark.createDataFrame([("s", p, p, 1, True, True, False, None, FACTS[p]) for p in names], P))
    out = match.with_fallback(queries, side(["p1"]), side(["p2", "p3"])).collect()
    assert len(out) == 1 and out[0]["stage"] == "sensory+bank" and out[0]["sufficient"]


def test_choose_prefers_new_cover_and_little_redundancy():
    import numpy as np

    gain, alike = np.array([[2.0, 0.0], [2.0, 0.0], [0.0, 2.0]]), np.array([[0, 1.0, 0], [1.0, 0, 0], [0, 0, 0]])
    base, place = np.full(3, 0.65), np.arange(3)
    assert match.choose(gain, base, place, alike, 6) == [(0, 2.8), (2, 2.8)]
    assert [p for p, _ in match.choose(np.zeros((3, 0)), base, place, alike, 6)] == [0, 2, 1]
    assert [p for p, _ in match.choose(np.zeros((3, 0)), base * 0.1, place, alike, 6)] == [0, 2]
    assert match.choose(np.zeros((0, 1)), np.zeros(0), np.zeros(0), np.zeros((0, 0)), 6) == []


def test_blocks_keep_what_later_stages_take(spark, monkeypatch):
    import random

    r = random.Random(4)
    words = [f"word{i}" for i in range(40)] + ["the", "更新", "a1"]
    say = lambda n: " ".join(r.choices(words, k=n))
    vector = lambda: r.choice([None, [r.uniform(-1, 1) for _ in range(4)], [0.0] * 4, [float("nan"), 1.0, 1.0, 1.0]])
    children = spark.createDataFrame([(r.choice("st"), f"p{i % 60}", f"c{i}", r.choice([None, "", say(6)]), vector(), r.choice(["m", "n", None])) for i in range(400)], C)
    parents = spark.createDataFrame([(s, f"p{i}", "d", i, i % 3 > 0, True, False, None, say(9)) for i in range(50) for s in "st"], P)
    queries = spark.createDataFrame([(i, r.choice("stu"), say(3), vector(), "m") for i in range(30)], Q)
    stages = lambda: [rows(f(match.Retrieval(queries, children, parents, split=False))) for f in (lambda x: x.admitted.drop("rank"), lambda x: x.guaranteed.drop("rank"), lambda x: x.picks)]
    whole = stages()
    monkeypatch.setattr(match, "ROW_BLOCK", 37)
    monkeypatch.setattr(match, "QUERY_BLOCK", 7)
    assert all(whole) and stages() == whole


def test_lexical_recall(spark):
    q = spark.createDataFrame([(1, "gateway port"), (2, None), (3, "the is a")], "query_id bigint, text string")
    c = spark.createDataFrame([(1, FACTS["p1"]), (2, FACTS["p2"]), (3, None), (4, "")], "candidate_id bigint, text string")
    got = match.lexical_recall(q, c, k=2)
    assert [(r["query_id"], r["candidate_id"], r["score"]) for r in got.collect()] == [(1, 1, 0.85)]


def test_dense_top_against_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(match, "ROW_BLOCK", 37)
    monkeypatch.setattr(match, "QUERY_BLOCK", 3)
    x = np.random.default_rng(0).normal(size=(150, 8)).astype("float32")
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id bigint, vector array<float>")
    got = match.dense_top(df.filter("row_id % 20 = 0").withColumnRenamed("row_id", "query_id"), df, k=4)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = sorted((q, int(r)) for q in range(0, 150, 20) for r in np.argsort(-(u @ u[q]), kind="stable")[:4])
    assert rows(got, "query_id", "row_id") == sorted(want, key=str)


def test_eligibility_order(spark):
    lit = F.lit
    reason = lambda core="x", refs=1, q=0.9, c=False, cur=True, st="active": spark.range(1).select(match.eligibility(lit(core), lit(refs), lit(q), lit(c), lit(cur), lit(st))).collect()[0][0]
    assert [reason(), reason(core=" "), reason(refs=0), reason(q=0.5), reason(c=True), reason(cur=False), reason(st="pending-vector")] == ["eligible", "empty-parent", "no-source-refs", "low-evidence-quality", "unresolved-conflict", "temporal-mismatch", "pending-vector"]


def test_validation(spark):
    parents = spark.createDataFrame([("p", "The  Parser is fast"), ("r", "unrelated")], "parent_id string, view string")
    refs = spark.createDataFrame([("p", "s", 1), ("r", "s", 1), ("p", "s", 9)], "parent_id string, session_id string, seq bigint")
    sources = spark.createDataFrame([("s", 1, "so the parser IS fast now")], "session_id string, seq bigint, text string")
    assert rows(match.validated(refs, sources, parents), "parent_id", "n_refs", "n_found", "reason") == [("p", 2, 1, "valid"), ("r", 1, 1, "source-chunk-mismatch")]


@pytest.mark.parametrize("limit", [1, 3])
def test_admission_limit(spark, limit):
    from stratalith.config import Config

    r = retrieval(spark)
    assert match.admitted(r.rows, Config(child_top_k=limit)).groupBy("sub").count().agg(F.max("count")).collect()[0][0] <= limit


def shuffled(spark):
    """Records that all stages so far wrote to a shuffle."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.jvm.java.util.ArrayList
    stages = store.stageList(none(), False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._gateway.jvm.double, 0), none())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_all_pairs_of_lexical_recall_against_brute_force(spark, monkeypatch):
    import random
    import re

    r = random.Random(6)
    words = ["port", "airport", "gateway", "gate", "way", "the", "is", "a", "x", "42", "3.5", "更新网关", "网关", "a-b", "b", "Ärger", "B."]
    say = lambda n: r.choice([" ", "  "]).join(r.choices(words, k=n))
    queries = [(i, r.choice([None, "", "b", *(say(r.randint(1, 4)) for _ in range(9))])) for i in range(30)] + [(90, "port gate way"), (91, "Port  gate way"), (92, "port gate way")]
    candidates = [(i, r.choice([None, "", *(say(9) for _ in range(9))])) for i in range(120)] + [(None, "an airport gate wayward take"), (200, "airport gate wayward")]
    clean = lambda x: re.sub(r"\s+", " ", x or "").strip().lower()

    def tokens(x):
        runs = re.findall("[㐀-鿿]+", clean(x))
        return {*re.findall(r"[a-z][\w-]*|\d+(?:\.\d+)?", clean(x), re.A), *runs, *(c[i : i + n] for c in runs for n in (2, 3, 4) for i in range(len(c) - n + 1))}

    want = []
    for q, a in queries:
        asked = {t for t in tokens(a) if t not in match.text.STOPWORDS and not re.fullmatch("[a-z]", t)}
        for c, b in candidates:
            hit = asked & tokens(b)
            strong = sum(len(t) >= 3 or bool(re.fullmatch(r"[㐀-鿿]{2,}|\d{2,}", t)) for t in hit)
            phrase, cover = len(clean(a)) >= 3 and clean(a) in clean(b), len(hit) / max(1, len(asked))
            score = 1.0 if phrase else 0.85 if cover >= 0.75 else 0.8 if strong >= 2 else 0.7 if cover >= 0.5 else 0.35 if cover >= 0.25 else 0.0
            if hit and score:
                want.append((q, c, len(hit), strong, cover, phrase, score))
    monkeypatch.setattr(match, "ROW_BLOCK", 37)
    got = match.lexical_recall(spark.createDataFrame(queries, "query_id bigint, text string"), spark.createDataFrame(candidates, "candidate_id bigint, text string"))
    assert {c for _, c, *_, phrase, _ in want if phrase} >= {None, 200} and rows(got) == sorted(want, key=str)


def test_all_pairs_of_lexical_recall_are_never_shuffled(spark):
    q = spark.createDataFrame([(i, "gateway port") for i in range(200)], "query_id bigint, text string")
    c = spark.createDataFrame([(i, f"gateway {i}") for i in range(300)], "candidate_id bigint, text string")
    before = shuffled(spark)
    match.lexical_recall(q, c).write.format("noop").mode("overwrite").save()
    assert 0 < shuffled(spark) - before < 2000
    assert match.lexical_recall(q, c).count() == 60000
