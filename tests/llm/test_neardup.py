import random
import re

from conftest import rows

from stratalith.llm import neardup

SHAPE = "member bigint, owner string, text string, class string, a int, runs string"


def brute(data, threshold, n):
    sets = []
    for m, o, t, *_ in dict.fromkeys(data):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets.append((m, o, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}))
    out = set()
    for i, (m, o, s) in enumerate(sets):
        for k, p, q in sets[:i]:
            if m is not None and k is not None and o is not None and p is not None and o != p and m != k and s and q and len(s & q) / len(s | q) >= threshold:
                out.add((min(m, k), max(m, k)))
    return sorted(out)


def corpus(seed=1, families=25):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    data = []
    for f in range(families):
        base = [r.choice(words) for _ in range(r.randrange(3, 120))]
        for _ in range(r.randrange(1, 6)):
            text = list(base)
            for _ in range(r.randrange(0, 6)):
                text[r.randrange(len(text))] = r.choice(words)
            data.append((len(data), f"d{len(data)}", " ".join(text), "x", 1, "y"))
    return data


def pairs(spark, data, **kw):
    df = spark.createDataFrame(data, SHAPE)
    return sorted((r["a"], r["b"]) for r in neardup.similar_pairs(*neardup.similar_classes(df, **kw)).collect())


def test_against_brute_force(spark):
    data = corpus() + [(900, "z", None, "x", 1, "y"), (901, "z", "", "x", 1, "y"), (902, "z", "one two", "x", 1, "y"), (None, "z", "a b c d", "x", 1, "y"), (903, None, corpus()[0][2], "x", 1, "y")]
    data += data[:20]
    for threshold, n in ((0.6, 3), (0.8, 5)):
        want = brute(data, threshold, n)
        assert pairs(spark, data, threshold=threshold, n=n) == want and want


def test_hot_root_is_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    r = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    data = [(i, f"d{i}", " ".join(base[: 50 + r.randrange(10)] + [f"u{i}"]), "x", 1, "y") for i in range(60)]
    want = brute(data, 0.6, 3)
    assert pairs(spark, data, threshold=0.6, n=3) == want and len(want) > 1000


def test_copies_and_groups(spark):
    text = "one two three four five six seven eight nine ten"
    data = [(i, f"d{i}", text, "x", 1, "y") for i in range(30)] + [(50, "d50", text + " eleven", "x", 1, "y"), (51, "d51", "something wholly different is written here", "x", 1, "y")]
    members, links = neardup.similar_classes(spark.createDataFrame(data, SHAPE), 0.6, 3)
    assert links.count() == 1  # one link between classes, not one for every copy
    got = neardup.groups(members, links)
    assert got.count() == 32 and got.select("group").distinct().count() == 2
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    assert {r["group"] for r in neardup.components(chain).collect()} == {0, 100}


def test_empty(spark):
    assert pairs(spark, [], threshold=0.6, n=3) == []


def test_thresholds_that_could_lose_links_are_refused(spark):
    import pytest

    for bad in (0.0, 0.02, 1.5):
        with pytest.raises(ValueError):
            neardup.similar_classes(spark.createDataFrame([], SHAPE), threshold=bad)
    for size in range(1, 5000):  # what is asked of two prefixes is never more than what similar sets share
        assert neardup.shared_least(size) <= -(-2 * neardup.LEAST * size // (1 + neardup.LEAST))


def test_both_ways_to_order_runs_agree(spark, monkeypatch):
    data = spark.createDataFrame(corpus(7, 12), SHAPE)
    monkeypatch.setattr(neardup, "HEAVY", 2)
    want = rows(neardup.similar_classes(data, 0.6, 3)[1])
    monkeypatch.setattr(neardup, "LISTED", 0)
    assert want and rows(neardup.similar_classes(data, 0.6, 3)[1]) == want
