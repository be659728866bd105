"""Long exact spans shared between documents, by repeated-phrase automata.

1. Every window of ``span`` words holds at least one *anchor*: the phrase of ``PHRASE`` words with the least hash in
   it. Equal windows choose equal anchors, so only anchors are shuffled (about 2 / (span - PHRASE + 2) of the words).
2. Anchors met under two or more ``doc_id``s recur. A recurring anchor belongs to the shard of the least ``doc_id`` that
   has it; so the phrases of one family of copies sit in one shard. Each document sends a shard only the passages that
   surround its own anchors there: no other part of it can be shared through that shard.
3. Each shard compiles the recurring phrases of its passages into an Aho-Corasick automaton over word numbers, streams
   the passages through it and finds every occurrence, word for word.
4. Only windows that hold an occurrence can be shared. They are confirmed within the shard, where all passages with
   that phrase are. A shard over ``SALT_WORDS`` words is salted; then the windows that its parts couldn't confirm alone
   are compared in one more shuffle, so no group is collected beyond that size.
"""

from __future__ import annotations

from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalith import storage
from stratalith.llm.hashing import MIX, TOP, WordValues, rolling, sliding

PHRASE = 12
SHARD_WORDS = 1_000_000
SALT_WORDS = 3_000_000
BATCH_WORDS = 200_000

ANCHOR = "hash bigint, rid bigint, doc_id bigint, pos int"
PASSAGE = "shard int, salt int, salted boolean, rid bigint, doc_id bigint, starts array<int>, positions array<int>, passages binary"
FOUND = "kind int, doc_id bigint, rid bigint, first int, last int, shard int, h1 bigint, h2 bigint"


def anchor_positions(values: np.ndarray, starts: np.ndarray, span: int, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of concatenated texts; ``starts`` has each text's first position, and the end."""
    n, width = len(values), span - phrase + 1
    sizes = np.diff(starts)
    end = np.repeat(starts[1:], sizes)
    at = np.arange(n)
    h = rolling(values, phrase)
    h[at + phrase > end] = TOP
    least = sliding(h, width, np.minimum)
    least[at + span > end] = 0
    # A position is chosen if some whole window [i, i + span) that holds its phrase has it as the least.
    back = sliding(least[::-1], width, np.maximum)[::-1]
    chosen = np.flatnonzero((back == h) & (h != TOP) & (back != 0))
    return chosen, h[chosen]


def _anchors(span: int):
    def run(batches):
        values_of = WordValues()

        def flush(ids, texts):
            words = [t.split() for t in texts]
            sizes = np.array([len(w) for w in words])
            starts = np.concatenate([[0], np.cumsum(sizes)])
            get = values_of.__getitem__
            values = np.fromiter(map(get, chain.from_iterable(words)), dtype=np.uint64, count=starts[-1])
            pos, h = anchor_positions(values, starts, span)
            row = np.searchsorted(starts, pos, side="right") - 1
            ids = np.array(ids, dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(ids[row, 0]), pa.array(ids[row, 1]), pa.array((pos - starts[row]).astype(np.int32))],
                names=["hash", "rid", "doc_id", "pos"],
            )

        for batch in batches:
            rid, doc, text = (batch.column(i) for i in range(3))
            ids, texts, size = [], [], 0
            for i in range(len(batch)):
                t = text[i].as_py()
                ids.append((rid[i].as_py(), doc[i].as_py()))
                texts.append(t)
                size += len(t)
                if size > BATCH_WORDS * 6:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
            if texts:
                yield flush(ids, texts)

    return run


def stretches(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions of the runs of true values."""
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def marked(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """True at positions that lie in some ``[begin, end)``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def _passages(span: int, phrase: int = PHRASE):
    """Of each document, for each of its shards, the words around its anchors there."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        schema = pa.schema([("shard", pa.int32()), ("salt", pa.int32()), ("salted", pa.bool_()), ("rid", pa.int64()), ("doc_id", pa.int64()), ("starts", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32())), ("passages", pa.binary())])
        for batch in batches:
            out, size, seen = [], 0, set()
            rid, doc, text, routes = (batch.column(i) for i in range(4))
            for i in range(len(batch)):
                r = rid[i].as_py()
                if r in seen:  # a repeated row
                    continue
                seen.add(r)
                words = text[i].as_py().split()
                for route in routes[i].as_py():
                    at = np.array(route["positions"], np.int64)
                    near = marked(np.maximum(at - span + phrase, 0), np.minimum(at + span, len(words)), len(words))
                    lo, hi = stretches(near)
                    blob = pack("\n".join(" ".join(words[a : b + 1]) for a, b in zip(lo, hi)).encode())
                    salts = route["salts"]
                    out.append((route["shard"], r % salts if salts > 1 else 0, salts > 1, r, doc[i].as_py(), lo.tolist(), route["positions"], blob))
                    size += len(blob)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def locate(passages: list[list[str]], begins: list[int], positions: list[list[int]], owner: list[int], span: int, phrase: int = PHRASE):
    """Candidate windows of a shard: their place in the concatenated words, two hashes, and passage; and the passages' starts.

    ``begins`` is the first word of each passage, ``owner`` its document, ``positions`` the anchors of each document.
    """
    number: dict[str, int] = {}
    rows = []
    for words in passages:
        for w in words:
            if w not in number:
                number[w] = len(number)
        rows.append(tuple(map(number.__getitem__, words)))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for row, first, doc in zip(rows, begins, owner):
        last = first + len(row) - phrase
        for p in positions[doc]:
            if first <= p <= last:
                automaton.add_word(row[p - first : p - first + phrase], 1)
    automaton.make_automaton()
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    n = int(starts[-1])
    begin, end = [], []
    for k, row in enumerate(rows):
        if len(row) >= span:
            hit = np.array([e for e, _ in automaton.iter(row)], dtype=np.int64) - phrase + 1
            lo = np.maximum(hit - (span - phrase), 0)
            hi = np.minimum(hit, len(row) - span)
            ok = lo <= hi
            begin.append(lo[ok] + starts[k])
            end.append(hi[ok] + 1 + starts[k])
    del automaton
    if not begin:
        return np.zeros(0, np.int64), np.zeros((2, 0), np.uint64), np.zeros(0, np.int64), starts
    at = np.flatnonzero(marked(np.concatenate(begin), np.concatenate(end), n))
    values = np.fromiter(map(WordValues().__missing__, number), dtype=np.uint64, count=len(number))
    values = values[np.fromiter(chain.from_iterable(rows), dtype=np.int64, count=n)]
    h = np.stack([rolling(values, span, m)[at] for m in MIX])
    return at, h, np.searchsorted(starts, at, side="right") - 1, starts


def confirmed(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window: whether it occurs under two documents here; and whether it is the first of its kind."""
    if not len(doc):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((h[1], h[0]))
    a, b = h[0][order], h[1][order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    at = np.flatnonzero(new)
    d = doc[order]
    two = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)
    shared, first = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    shared[order] = np.repeat(two, np.diff(np.concatenate([at, [len(d)]])))
    first[order] = new
    return shared, first


def _shard(span: int):
    def run(key, table):
        salted, shard = table.column("salted")[0].as_py(), key[0].as_py()
        unpack = zstandard.ZstdDecompressor().decompress
        owner, passages = [], []
        for i, blob in enumerate(table.column("passages").to_pylist()):
            lines = unpack(blob).decode().split("\n")
            owner += [i] * len(lines)
            passages += [line.split(" ") for line in lines]
        begins = table.column("starts").combine_chunks().flatten().to_numpy().astype(np.int64)
        at, h, row, starts = locate(passages, begins.tolist(), table.column("positions").to_pylist(), owner, span)
        owner = np.array(owner, np.int64)
        doc, rid = table.column("doc_id").to_numpy()[owner], table.column("rid").to_numpy()[owner]
        shared, first = confirmed(h, doc[row])
        parts = []

        def add(kind, rows, begin, h=None):
            n = len(rows)
            h = np.zeros((2, n), np.int64) if h is None else h.view(np.int64)
            end = begin + span - 1 if kind else stop
            parts.append([np.full(n, kind, np.int32), doc[rows], rid[rows], (begins[rows] + begin).astype(np.int32), (begins[rows] + end).astype(np.int32), np.full(n, shard, np.int32), h[0], h[1]])

        if shared.any():
            covered = marked(at[shared], at[shared] + span, int(starts[-1]))
            covered = np.insert(covered, starts[1:-1], False)  # a stretch never runs on into the next passage
            lo, stop = stretches(covered)
            apart = starts + np.arange(len(starts))
            rows = np.searchsorted(apart, lo, side="right") - 1
            stop = stop - apart[rows]
            add(0, rows, lo - apart[rows])
        if salted:
            alone, told = np.flatnonzero(~shared), np.flatnonzero(shared & first)
            add(1, row[alone], at[alone] - starts[row[alone]], h[:, alone])
            add(2, row[told], at[told] - starts[row[told]], h[:, told])
        names = [c.split()[0] for c in FOUND.split(", ")]
        columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int32 if i in (0, 3, 4, 5) else np.int64) for i in range(len(names))]
        return pa.table(dict(zip(names, columns)))

    return run


def shared_spans(docs: DataFrame, span: int = 40, shard_words: int = SHARD_WORDS, salt_words: int = SALT_WORDS) -> DataFrame:
    """``doc_id, rid, first_word, last_word``: the longest stretches of words that lie in runs of ``span`` words equal to
    a run of another ``doc_id``. Words are the longest runs without white space, numbered from 0.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Rows with a null id or text have no result. Rows
    that repeat an id count as one document; ``rid`` tells its different texts apart. Texts under ``span`` words and
    empty tables give no row. No text is cut and no group of copies is thinned.
    """
    if span < 2 * PHRASE:
        raise ValueError(f"span must be at least {2 * PHRASE}")
    spark = docs.sparkSession
    docs = docs.select(F.xxhash64("doc_id", "text").alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    docs = docs.filter(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * span - 1))
    anchors = storage.materialize(docs.mapInArrow(_anchors(span), ANCHOR), "anchors")
    shards = max(1, round(anchors.count() * (span - PHRASE + 2) / 2 / shard_words))
    recurring = anchors.groupBy("hash").agg(F.min("doc_id").alias("home"), F.max("doc_id").alias("other"))
    recurring = recurring.filter("home < other").select("hash", F.pmod(F.xxhash64("home"), F.lit(shards)).cast("int").alias("shard"))
    routes = anchors.select("hash", "rid", "pos").join(recurring, "hash").groupBy("rid", "shard").agg(F.collect_set("pos").alias("positions"))
    routes = storage.materialize(routes, "routes")
    # The words that a document sends: of each anchor those around it, of near ones what lies between them once.
    reach, at, n = 2 * span - PHRASE, F.array_sort("positions"), F.size("positions")
    sent = F.aggregate(F.zip_with(F.slice(at, 2, n), F.slice(at, 1, n - 1), lambda b, a: b - a), F.lit(reach).cast("bigint"), lambda t, gap: t + F.least(gap, F.lit(reach)))
    loads = routes.withColumn("sent", sent).groupBy("shard").agg(F.ceil(F.sum("sent") / salt_words).cast("int").alias("salts"))
    by_text = routes.join(loads, "shard").groupBy("rid").agg(F.collect_list(F.struct("shard", "salts", "positions")).alias("routes"))
    placed = docs.join(by_text.hint("shuffle_hash"), "rid").select("rid", "doc_id", "text", "routes").mapInArrow(_passages(span), PASSAGE)
    found = placed.groupBy("shard", "salt").applyInArrow(_shard(span), FOUND)
    found = storage.materialize(found, "found")
    windows = found.filter("kind > 0")
    across = windows.groupBy("shard", "h1", "h2").agg(F.max("kind").alias("k"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("k = 2 or a < b")
    columns = ["doc_id", "rid", "first", "last"]
    late = windows.filter("kind = 1").join(across, ["shard", "h1", "h2"], "left_semi").select(columns)
    return merged(found.filter("kind = 0").select(columns).unionByName(late))


def merged(intervals: DataFrame) -> DataFrame:
    """Union of overlapping and adjoining intervals of each text."""
    w = Window.partitionBy("doc_id", "rid").orderBy("first", "last")
    before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = intervals.withColumn("new", F.when(before.isNull() | (F.col("first") > before + 1), 1).otherwise(0))
    out = out.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy("doc_id", "rid", "run").agg(F.min("first").cast("bigint").alias("first_word"), F.max("last").cast("bigint").alias("last_word")).drop("run")


def shared_share(docs: DataFrame, span: int = 40) -> DataFrame:
    """``doc_id, n_words, shared_words, shared_share`` of every document with an id: how much of it stands elsewhere.

    Null and blank texts have 0 words and share 0.0. The different texts of a repeated id are added up.
    """
    texts = docs.select(F.xxhash64("doc_id", "text").alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null")
    words = F.coalesce(F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")), F.lit(0)).cast("bigint")
    totals = texts.select("doc_id", "rid", words.alias("n_words")).groupBy("doc_id", "rid").agg(F.max("n_words").alias("n_words"))
    spans = shared_spans(docs, span).groupBy("doc_id", "rid").agg(F.sum(F.expr("last_word - first_word + 1")).alias("shared_words"))
    both = totals.join(spans, ["doc_id", "rid"], "left").groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum(F.coalesce("shared_words", F.lit(0))).alias("shared_words"))
    return both.withColumn("shared_share", F.when(F.col("n_words") > 0, F.col("shared_words") / F.col("n_words")).otherwise(0.0))
