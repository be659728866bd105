import numpy as np
from conftest import rows

from stratalith.llm import neighbours

SHAPE = "child_no bigint, vector_model string, vector array<float>, path int, role string, ck string"


def table(spark, data):
    return spark.createDataFrame([(i, m, None if v is None else [None if x is None else float(x) for x in v], 1, "r", "c") for i, m, v in data], SHAPE)


def brute(ids, x, k):
    x = np.asarray(x, np.float32).astype(float)
    s = np.round(x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)), 12)
    np.fill_diagonal(s, -3)
    return {ids[i]: [ids[j] for j in np.lexsort((ids, -s[i]))[:k]] for i in range(len(ids))}


def clustered(n, seed=0, d=64):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(n // 12, d))
    return (centers[r.integers(len(centers), size=n)] + 0.15 * r.normal(size=(n, d))).astype(np.float32)


def recall(got, want):
    hits = sum(len({x["id"] for x in r["near"]} & set(want[r["child_no"]])) for r in got)
    return hits / sum(map(len, want.values()))


def test_recall(spark):
    x = clustered(1500)
    got = neighbours.nearest(table(spark, [(i, "m", v) for i, v in enumerate(x)])).collect()
    assert len(got) == 1500 and recall(got, brute(list(range(1500)), x, 5)) >= 0.95


def test_cells_that_are_split(spark):
    x = clustered(1500, 1)
    got = neighbours.nearest(table(spark, [(i, "m", v) for i, v in enumerate(x)]), cell_rows=40).collect()
    assert recall(got, brute(list(range(1500)), x, 5)) >= 0.9


def test_every_depth_of_cells_keeps_its_recall(spark, monkeypatch):
    x = clustered(1500, 8)
    data, want = table(spark, [(i, "m", v) for i, v in enumerate(x)]), brute(list(range(1500)), x, 5)
    over = neighbours.oversized(data, 64, 10)
    assert 2 <= len(over) <= neighbours.LEVELS
    for levels in (1, 2, 5):  # at 1 and 2 the last cells are worked through in pairs of blocks
        monkeypatch.setattr(neighbours, "LEVELS", levels)
        monkeypatch.setattr(neighbours, "CELL_ROWS", 16)
        got = neighbours.nearest(data, cell_rows=10).collect()
        assert len(got) == 1500 and recall(got, want) >= 0.95, levels


def test_hot_cell_in_blocks_is_exact(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 50)
    r = np.random.default_rng(2)
    x = (np.ones((400, 64)) * np.arange(1, 65) + 1e-4 * r.normal(size=(400, 64))).astype(np.float32)
    got = neighbours.nearest(table(spark, [(i, "m", v) for i, v in enumerate(x)]), cell_rows=50).collect()
    assert recall(got, brute(list(range(400)), x, 5)) >= 0.99


def test_copies_ties_and_bad_vectors(spark):
    r = np.random.default_rng(3)
    v, w = r.normal(size=64), r.normal(size=64)
    data = [(i, "m", v) for i in range(40)] + [(50, "m", w), (51, "n", v), (60, None, v), (None, "m", v), (61, "m", None), (62, "m", v[:5]), (63, "m", [0.0] * 64), (64, "m", [float("nan")] * 64), (65, "m", [float("inf")] * 64), (66, "m", [None] * 64)]
    got = {r["child_no"]: [x["id"] for x in r["near"]] for r in neighbours.nearest(table(spark, data + data[:10])).collect()}
    assert got[0] == [1, 2, 3, 4, 5] and got[3] == [0, 1, 2, 4, 5] and got[30] == [0, 1, 2, 3, 4]
    assert 51 not in got and not {60, 61, 62, 63, 64, 65, 66} & set(got)
    assert set(got) <= set(range(40)) | {50}


def test_several_vectors_of_one_id_and_empty(spark):
    r = np.random.default_rng(4)
    v, w = r.normal(size=64), r.normal(size=64)
    data = [(1, "m", v), (1, "m", w), (1, "m", [0.0] * 64), (2, "m", v), (3, "m", w)]
    near = neighbours.nearest(table(spark, data))
    assert near.count() == 3 or near.count() == 2
    assert rows(neighbours.links(near)) == rows(neighbours.links(neighbours.nearest(table(spark, data[::-1]))))
    assert neighbours.nearest(table(spark, [])).count() == 0


def test_rows_without_enough_in_their_cells_are_searched_exactly(spark, monkeypatch):
    x = np.concatenate([clustered(600, 5), np.random.default_rng(6).normal(size=(40, 64)).astype(np.float32)])
    data = [(i, "m", v) for i, v in enumerate(x)] + [(1000 + i, "few", v) for i, v in enumerate(x[:4])] + [(2000, "one", x[0])]
    for cap, block in ((8192, 8192), (5, 8192), (5, 100)):
        monkeypatch.setattr(neighbours, "CELL_ROWS", block)
        got = {r["child_no"]: [n["id"] for n in r["near"]] for r in neighbours.nearest(table(spark, data), cell_rows=cap).collect()}
        assert set(got) == set(range(640)) | set(range(1000, 1004))
        assert {i: len(n) for i, n in got.items()} == {i: 5 if i < 1000 else 3 for i in got}
        assert {i: got[i] for i in range(1000, 1004)} == brute(list(range(1000, 1004)), x[:4], 3)


def test_exact_search_in_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 100)
    x = clustered(600, 7)
    data, short = [(i, "m", v) for i, v in enumerate(x)], spark.range(0, 600, 4).withColumnRenamed("id", "child_no")
    found = neighbours._merged(neighbours._exact(table(spark, data + data[:50]), short, 5, 64), 5)
    want = brute(list(range(600)), x, 5)
    assert {r["child_no"]: [n["id"] for n in r["near"]] for r in found.collect()} == {i: want[i] for i in range(0, 600, 4)}


def test_three_comparable_rows_and_a_lone_vector_are_whole(spark):
    r = np.random.default_rng(4)
    v, w = r.normal(size=64), r.normal(size=64)
    near = neighbours.nearest(table(spark, [(1, "m", v), (2, "m", v), (3, "m", w)]))
    assert {r["child_no"]: len(r["near"]) for r in near.collect()} == {1: 2, 2: 2, 3: 2}
    near = neighbours.nearest(table(spark, [(i, "m", v) for i in range(40)] + [(50, "m", w)]))
    assert {r["child_no"]: [x["id"] for x in r["near"]] for r in near.collect()}[50] == [0, 1, 2, 3, 4]
