import collections
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalith.llm import mixing, packing, tokens


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=25))
def test_fit_loses_nothing(sizes):
    groups = packing.fit(sizes, 60)
    back = collections.Counter()
    for items, n in groups:
        assert n > 0 and sum(items) <= 60
        for s in items:
            back[s] += n
    assert dict(back) == sizes
    table = packing.slots(groups)
    assert set(table) == set(sizes)


def test_fill_is_tight():
    r = random.Random(0)
    sizes = collections.Counter(min(2048, int(r.lognormvariate(6.2, 0.8)) + 1) for _ in range(20_000))
    groups = packing.fit(dict(sizes), 2048)
    used, n = sum(s * c for s, c in sizes.items()), sum(c for _, c in groups)
    assert used / (n * 2048) > 0.99


def test_pack(spark):
    r = random.Random(1)
    data = [(i, " ".join(r.choice(["ruling", "court", "appeal"]) for _ in range(r.randrange(1, 90))), 1) for i in range(400)]
    data += [(1000, None, 1), (1001, " \n ", 1), (1002, "court " * 300, 1), (0, data[0][1], 1), (None, "no id", 1)]
    got = packing.pack(spark.createDataFrame(data, "doc_id bigint, text string, place int"), 100).toPandas()
    enc = tokens.encoder().encode_ordinary
    want = sum(len(enc(t)) for _, t, _ in data if t and t.strip())
    assert got.n_tokens.sum() == want and got.groupby("container_no").n_tokens.sum().max() <= 100
    assert not got.duplicated(["container_no", "start_token"]).any() and got.container_no.nunique() == got.container_no.max() + 1
    long = got[got.doc_id == 1002].sort_values("piece_no")
    assert list(long.n_tokens[:-1]) == [100] * (len(long) - 1) and set(got[got.piece_no > 0].doc_id) == {1002}
    assert (got.doc_id == 0).sum() == 2 and got.doc_id.isna().sum() == 1
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), 100).count() == 0
    with pytest.raises(ValueError):
        packing.capacity_of(spark.createDataFrame([("a", 5)], "container_kind string, capacity_tokens int"), "b")


DOC = "doc_id bigint, text string, source string, tokens int, copy_no int"
TARGET = "source string, target_share double, max_repeats int, demand int"


def test_mix(spark):
    r = random.Random(2)
    data = [(i, "court " * r.randrange(5, 60), s, 1, 1) for i, s in enumerate(r.choices(["Big", " big ", "small", "other", None], [60, 20, 5, 10, 5], k=1500))]
    data += [(5000, None, "big", 1, 1), (5001, " ", "big", 1, 1), (None, "court", "big", 1, 1), (0, data[0][1], data[0][2], 1, 1)]
    targets = [("BIG", 0.6, 1, 1), ("small ", 0.2, 3, 1), ("missing", 0.2, 1, 1), (None, 0.5, 1, 1)]
    mixture, report = mixing.mix(spark.createDataFrame(data, DOC), spark.createDataFrame(targets, TARGET), total=mixing.SCARCEST)
    got = mixture.toPandas()
    assert got.position.is_monotonic_increasing and got.position.between(0, 1).all()
    assert not got.duplicated(["doc_id", "copy_no"]).any() and got[got.source == "small"].copy_no.max() == 3 and got[got.source == "big"].copy_no.max() == 1
    rep = {r["source"]: r for r in report.collect()}
    assert abs(rep["big"]["share_reached"] - 0.75) < 0.01 and rep["missing"]["mixed_tokens"] == 0 and set(rep) == {"big", "small", "missing"}
    again = mixing.mix(spark.createDataFrame(data[::-1], DOC), spark.createDataFrame(targets, TARGET), total=mixing.SCARCEST)[0].toPandas()
    assert got.equals(again)
    empty = mixing.mix(spark.createDataFrame([], DOC), spark.createDataFrame(targets, TARGET))
    assert empty[0].count() == 0 and empty[1].count() == 3


def test_total_of_the_whole_collection(spark, monkeypatch):
    data = [(i, "court " * 10, "big" if i % 10 else "small", 1, 1) for i in range(1000)]
    targets = [("big", 0.5, 1, 1), ("small", 0.5, 2, 1)]
    make = lambda **kw: mixing.mix(spark.createDataFrame(data, DOC), spark.createDataFrame(targets, TARGET), **kw)
    rep = {r["source"]: r for r in make()[1].collect()}
    each = rep["small"]["tokens"] // 100
    # half of all tokens from each: 500 documents of big, but small has 100 and may be used twice
    assert rep["big"]["mixed_documents"] == 500 and rep["small"]["mixed_tokens"] == 200 * each and rep["small"]["copies"] == 2
    assert rep["small"]["shortfall"] == 300 * each and rep["big"]["shortfall"] == 0
    rep = {r["source"]: r for r in make(total=100 * each)[1].collect()}
    assert {r["mixed_documents"] for r in rep.values()} == {50} and {r["shortfall"] for r in rep.values()} == {0}
    few = make()[0].toPandas()
    monkeypatch.setattr(mixing, "FEWEST", 1)
    assert few.equals(make()[0].toPandas())  # however many ranges


def test_hot_size_is_salted_by_its_count(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 30)
    data = [(i if i % 3 else None, "court " * 400) for i in range(300)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    got = packing.pack(docs, 100)
    assert got.groupBy("container_no").count().count() == got.select("container_no").distinct().count() and got.filter("n_tokens = 100").count() == got.filter("n_tokens = 100").select("container_no").distinct().count()
    assert packing.checked(got, 100).collect()[0].asDict() == {"n_documents": 300, "over_capacity": 0, "misplaced": 0, "cut_early": 0}


def test_schedule(spark):
    data = [(i, "court " * 10, s, 1, 1) for i, s in enumerate(["a", "b"] * 500)]
    targets = [("a", 0.5, 1, 1), ("b", 0.5, 1, 1)]
    mixture, _ = mixing.mix(spark.createDataFrame(data, DOC), spark.createDataFrame(targets, TARGET), schedules={"a": [(0, 1), (0.5, 1), (1, 0)], "b": [(0, 0), (0.5, 1), (1, 1)]})
    got = mixture.toPandas()
    early = got[got.position < 0.25]
    assert (early.source == "a").mean() > 0.75
    with pytest.raises(ValueError):
        mixing.cumulative([(0, 0), (1, 0)])
