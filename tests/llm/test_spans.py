import random

import numpy as np
from conftest import rows

from stratalith.llm import spans

SHAPE = "doc_id bigint, text string, rid string, shard int, kind int"


def brute(data, span):
    own, out = {}, set()
    words = [(d, t.split()) for d, t in dict.fromkeys((d, t) for d, t in data if d is not None and t is not None)]
    for d, w in words:
        for i in range(len(w) - span + 1):
            own.setdefault(tuple(w[i : i + span]), set()).add(d)
    for d, w in words:
        covered = np.zeros(len(w) + 1, bool)
        for i in range(len(w) - span + 1):
            if len(own[tuple(w[i : i + span])]) > 1:
                covered[i : i + span] = True
        lo, hi = spans.stretches(covered)
        out |= {(d, int(a), int(b)) for a, b in zip(lo, hi)}
    return sorted(out, key=str)


def corpus(seed, n=120):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(300)}"
    passages = [[word() for _ in range(r.randrange(20, 120))] for _ in range(15)]
    out = []
    for d in range(n):
        text = []
        for _ in range(r.randrange(0, 4)):
            text += r.choice(passages) if r.random() < 0.7 else [word() for _ in range(r.randrange(1, 80))]
        for _ in range(r.randrange(0, 3)):
            if text:
                text[r.randrange(len(text))] = "edit"
        out.append((d, (" ", "\n")[d % 2].join(text)))
    return out


def found(spark, data, **kw):
    df = spark.createDataFrame([(d, t, "x", 1, 1) for d, t in data], SHAPE)
    return rows(spans.shared_spans(df, **kw).select("doc_id", "first_word", "last_word").distinct())


def test_against_brute_force(spark):
    data = corpus(1) + [(500, None), (501, ""), (502, "a " * 200), (503, "a " * 130), (None, corpus(1)[0][1]), (0, corpus(1)[0][1])]
    want = brute(data, 40)
    assert found(spark, data) == want and len(want) > 20


def test_many_shards_and_salts(spark):
    data = corpus(2)
    want = brute(data, 40)
    assert found(spark, data, shard_words=1500, salt_words=400) == want


def test_one_id_with_two_texts_is_no_partner_of_itself(spark):
    text = " ".join(f"q{i}" for i in range(60))
    assert found(spark, [(1, text), (1, text + " more")]) == []
    assert found(spark, [(1, text), (2, text + " more")]) == [(1, 0, 59), (2, 0, 59)]
    assert found(spark, []) == []


def test_share(spark):
    text = " ".join(f"q{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, "x", 1, 1), (2, "start " + text, "x", 1, 1), (3, None, "x", 1, 1)], SHAPE)
    got = rows(spans.shared_share(df), "doc_id", "n_words", "shared_words")
    assert got == [(1, 60, 60), (2, 61, 60), (3, 0, 0)]
