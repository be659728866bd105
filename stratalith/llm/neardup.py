"""Pairs of texts whose sets of word runs are similar, by signature trees.

1. Texts with the same set of runs are one *class*; only one set per class goes on.
2. Runs are ordered from rare to frequent (counts over all classes; those in fewer than ``HEAVY`` classes go first). Two sets can reach the threshold only if their
   prefixes in that order share a number of runs (``shared_least``), so each prefix run is the root of a tree over the
   classes that have it. This is the top level of the search: roots without a common run have no possible overlap.
3. Within a root, classes are leaves of a tree whose nodes hold the OR of their members' bitmaps, the range of their
   sizes and their largest number of runs that fell on a taken bit. Two nodes are traversed together level by level; a
   pair is dropped if sizes rule it out or the common bits and the surplus bound the overlap below what is needed.
4. Pairs of leaves left under fewer roots than they must share are dropped; the others are compared exactly.

Roots over ``BLOCK`` classes are split into blocks, and trees are built for pairs of blocks, so no task collects more than
two blocks of one root. No class or partner is ever dropped.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith import storage
from stratalith.llm.hashing import WordValues, rolling

BITS, FANOUT, LEAVES, BLOCK, CHUNK = 512, 8, 32, 512, 100_000
#: Runs of fewer classes count as equally rare; their roots are small. As many frequent ones at most are sent to all tasks.
HEAVY, LISTED, LEAST = 32, 200_000, 0.03
WORD = re.compile(r"[^\W_]+")


def run_set(text: str, n: int, values: WordValues) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``n`` successive words."""
    words = WORD.findall(text.lower())
    if len(words) < n:
        return np.zeros(0, np.uint64)
    v = np.fromiter(map(values.__getitem__, words), dtype=np.uint64, count=len(words))
    return np.unique(rolling(v, n)[: len(words) - n + 1])


SETS = "member bigint, owner string, class bigint, runs array<bigint>"


def _sets(n: int):
    def run(batches):
        values = WordValues()
        for batch in batches:
            member, owner, text = (batch.column(i) for i in range(3))
            for lo in range(0, len(batch), 500):
                part = [run_set(t.as_py() or "", n, values) for t in text[lo : lo + 500]]
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in part])]).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(part).view(np.int64)))
                name = pa.array(np.array([xxhash.xxh3_64_intdigest(p.tobytes()) for p in part], np.uint64).view(np.int64))
                full = pa.array(np.diff(offsets) > 0)
                yield pa.RecordBatch.from_arrays([member[lo : lo + 500], owner[lo : lo + 500], name, runs], names=["member", "owner", "class", "runs"]).filter(full)

    return run


LEAF = "class bigint, size int, least bigint, bits binary"
ROOT = "root bigint, class bigint"


def signature(runs: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, bool)
    bits[(runs >> np.uint64(20)) % np.uint64(BITS)] = True
    return np.packbits(bits)


def _leaves(batches):
    for batch in batches:
        name, runs = batch.column(0), batch.column(1)
        offsets, flat = runs.offsets.to_numpy(), runs.values.to_numpy(zero_copy_only=False).view(np.uint64)
        parts = [flat[a:b] for a, b in zip(offsets, offsets[1:])]
        least = np.array([p.min() for p in parts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([name, pa.array(np.diff(offsets).astype(np.int32)), pa.array(least), pa.array([signature(p).tobytes() for p in parts], pa.binary())], names=["class", "size", "least", "bits"])


def shared_least(size):
    """How many runs the prefixes of two sets must share, by the smaller set's size: one, and a twentieth of it."""
    return 1 + size // 20


def _roots(threshold: float, often: np.ndarray, counts: np.ndarray):
    """The runs in the prefix of each class. ``often`` is sorted; runs that it lacks are rare and go first."""

    def run(batches):
        for batch in batches:
            name, runs = batch.column(0).to_numpy(), batch.column(1)
            offsets, flat = runs.offsets.to_numpy(), runs.values.to_numpy(zero_copy_only=False)
            sizes = np.diff(offsets)
            at = np.minimum(np.searchsorted(often, flat), max(len(often) - 1, 0))
            df = np.where(often[at] == flat, counts[at], 0) if len(often) else np.zeros(len(flat), np.int64)
            base, n = offsets[0], int(sizes.sum())
            flat, df = flat[base : base + n], df[base : base + n]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((flat, df, owner))
            place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            prefix = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + shared_least(sizes)
            keep = place < np.repeat(prefix, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(flat[order][keep]), pa.array(name[owner[keep]])], names=["root", "class"])

    return run


def joined_roots(classes: DataFrame, heavy: DataFrame, threshold: float) -> DataFrame:
    """The same prefixes where the frequent runs are too many to be sent to all tasks: counts come by a join on the run."""
    size = F.col("size")
    rows = classes.select("class", F.size("runs").alias("size"), F.explode("runs").alias("run")).join(heavy, "run", "left")
    rows = rows.groupBy("class", "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "run"))).alias("runs"))
    prefix = size - F.ceil(size * threshold - 1e-9).cast("int") + 1 + F.floor(size / 20).cast("int")
    return rows.select(F.explode(F.transform(F.slice("runs", F.lit(1), prefix), lambda r: r["run"])).alias("root"), "class")


def possible(size_a, most_a, size_b, most_b, common, surplus, threshold):
    """Whether two nodes can hold a pair of the threshold: smallest and largest sizes, common bits, least surplus."""
    need = threshold / (1 + threshold) * (size_a + size_b) - 1e-9
    overlap = np.minimum(common + surplus, np.minimum(most_a, most_b))
    return (overlap >= need) & (most_a >= threshold * size_b - 1e-9) & (most_b >= threshold * size_a - 1e-9)


def traverse(bits: np.ndarray, size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves (first before second) that the nodes above them and their own bitmaps don't rule out."""
    levels = [(bits, size, size, size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64))]
    while len(levels[-1][1]) > 1:
        b, lo, hi, surplus = levels[-1]
        at = np.arange(0, len(lo), FANOUT)
        levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(surplus, at)))
    a = b = np.zeros(1, np.int64)
    for above in range(len(levels) - 1, -1, -1):
        bit, lo, hi, surplus = levels[above]
        keep = np.zeros(len(a), bool)
        for i in range(0, len(a), CHUNK):
            x, y = a[i : i + CHUNK], b[i : i + CHUNK]
            common = np.bitwise_count(bit[x] & bit[y]).sum(axis=1, dtype=np.int64)
            keep[i : i + CHUNK] = possible(lo[x], hi[x], lo[y], hi[y], common, np.minimum(surplus[x], surplus[y]), threshold) | ((x == y) & (above > 0))
        a, b = a[keep], b[keep]
        if not above:
            break
        n = len(levels[above - 1][1])
        step = np.arange(FANOUT)
        a = (a[:, None] * FANOUT + step)[:, :, None].repeat(FANOUT, axis=2).reshape(-1)
        b = np.broadcast_to((b[:, None] * FANOUT + step)[:, None, :], (len(b), FANOUT, FANOUT)).reshape(-1)
        inside = (a < n) & (b < n) & ((a < b) if above == 1 else (a <= b))
        a, b = a[inside], b[inside]
    return a[a < b], b[a < b]


def _trees(threshold: float):
    def pairs_of(key, block, cross, name, size, bits):
        """Candidate pairs of whole groups, in order of ``key``."""
        edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]])) if len(key) else np.zeros(1, int)
        length = np.diff(edges)
        group = np.repeat(np.arange(len(length)), length)
        surplus = size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        small = length[group] <= LEAVES
        out = []
        for d in range(1, min(LEAVES, int(length.max(initial=0)))):
            x = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]))
            if not len(x):
                break
            common = np.bitwise_count(bits[x] & bits[x + d]).sum(axis=1, dtype=np.int64)
            ok = possible(size[x], size[x], size[x + d], size[x + d], common, np.minimum(surplus[x], surplus[x + d]), threshold)
            out.append((x[ok], x[ok] + d))
        for g in np.flatnonzero(length > LEAVES):
            a, b = traverse(bits[edges[g] : edges[g + 1]], size[edges[g] : edges[g + 1]], threshold)
            out.append((a + edges[g], b + edges[g]))
        x, y = (np.concatenate([p[i] for p in out]) if out else np.zeros(0, np.int64) for i in (0, 1))
        ok = ~cross[x] | (block[x] != block[y])
        x, y = x[ok], y[ok]
        need = shared_least(np.minimum(size[x], size[y]))
        pairs, n = np.unique(np.stack([np.minimum(name[x], name[y]), np.maximum(name[x], name[y]), need], axis=1), axis=0, return_counts=True) if len(x) else (np.zeros((0, 3), np.int64), np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([*(pa.array(pairs[:, i]) for i in range(3)), pa.array(n.astype(np.int64))], names=["a", "b", "need", "n"])

    def run(batches):
        kept, n = [], 0

        def columns(tables):
            t = pa.Table.from_batches(tables).combine_chunks()
            key = np.stack([t.column(c).to_numpy() for c in ("root", "low", "high")], axis=1)
            bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
            return key, t.column("block").to_numpy(), key[:, 1] != key[:, 2], t.column("class").to_numpy(), t.column("size").to_numpy().astype(np.int64), bits

        for batch in batches:
            if not len(batch):
                continue
            kept.append(batch)
            n += len(batch)
            if n < CHUNK:
                continue
            c = columns(kept)
            new = np.flatnonzero((c[0][1:] != c[0][:-1]).any(axis=1))
            if not len(new):
                continue
            cut = int(new[-1]) + 1
            yield pairs_of(*(x[:cut] for x in c))
            whole = pa.Table.from_batches(kept).slice(cut).combine_chunks()
            kept, n = whole.to_batches(), len(whole)
        if kept:
            yield pairs_of(*columns(kept))

    return run


def similar_classes(texts: DataFrame, threshold: float = 0.8, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """Membership ``member, owner, class`` and similar classes ``a, b, similarity`` (a < b).

    ``texts`` has ``member`` (bigint), ``owner`` (string) and ``text``. Repeated rows are one; of a member with several
    texts each counts. Texts of fewer than ``n`` words, null texts and null members belong to no class.
    """
    if not LEAST <= threshold <= 1:  # below, similar sets may share fewer runs than `shared_least` asks for
        raise ValueError(f"threshold must lie from {LEAST} to 1")
    rows = texts.select(F.col("member").cast("bigint").alias("member"), F.col("owner").cast("string").alias("owner"), "text").filter("member is not null and text is not null")
    sets = storage.materialize(rows.mapInArrow(_sets(n), SETS), "sets")
    members = sets.select("member", "owner", "class").distinct()
    classes = storage.materialize(sets.select("class", "runs").dropDuplicates(["class"]), "classes")
    heavy = classes.select(F.explode("runs").alias("run")).groupBy("run").count().filter(F.col("count") >= HEAVY)
    heavy = storage.materialize(heavy, "heavy")
    if heavy.count() <= LISTED:
        listed = heavy.toArrow()
        often, counts = (listed.column(i).to_numpy().astype(np.int64) for i in (0, 1))
        order = np.argsort(often)
        roots = classes.mapInArrow(_roots(threshold, often[order], counts[order]), ROOT)
    else:
        roots = joined_roots(classes, heavy, threshold)
    roots = storage.materialize(roots, "roots", heavy)
    leaves = classes.mapInArrow(_leaves, LEAF)
    size = roots.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.when(F.col("n") > 2 * BLOCK, F.ceil(F.col("n") / BLOCK)).otherwise(1).cast("int")
    placed = roots.join(size, "root").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("root", "class", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    placed = placed.join(leaves, "class").repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "least", "size")
    pairs = placed.select("root", "low", "high", "block", "class", "size", "bits").mapInArrow(_trees(threshold), "a bigint, b bigint, need bigint, n bigint")
    pairs = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need")).filter("n >= need").select("a", "b")
    pairs = storage.materialize(pairs, "pairs", roots)
    both = pairs.join(classes.select(F.col("class").alias("a"), F.col("runs").alias("ra")), "a").join(classes.select(F.col("class").alias("b"), F.col("runs").alias("rb")), "b")
    shared = F.size(F.array_intersect("ra", "rb"))
    both = both.select("a", "b", (shared / (F.size("ra") + F.size("rb") - shared)).alias("similarity"))
    return members, both.filter(F.col("similarity") >= threshold)


def similar_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of members of different owners that are in one class or in linked classes: ``a, b, similarity``.

    A null owner is unknown and differs from none.
    """
    left = members.select(F.col("member").alias("x"), F.col("owner").alias("ox"), F.col("class").alias("a"))
    right = members.select(F.col("member").alias("y"), F.col("owner").alias("oy"), F.col("class").alias("b"))
    linked = links.join(left, "a").join(right, "b").filter("ox <> oy and x <> y")
    same = left.join(right, F.col("a") == F.col("b")).filter("x < y and ox <> oy").withColumn("similarity", F.lit(1.0))
    columns = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity"]
    return linked.select(columns).unionByName(same.select(columns)).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def components(links: DataFrame) -> DataFrame:
    """``node, group``: the least node of each connected component, by large-star and small-star steps (all distributed)."""
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u")
        if large:
            return out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        return out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()

    pairs = storage.materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        pairs = storage.materialize(star(star(pairs, True), False), "edges", pairs)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if state == seen:
            break
        seen = state
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("group")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("group")).distinct())


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per member: ``member, class, group, n_links`` (links of its class to other classes)."""
    part = components(links)
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    named = part.join(degree, "node")
    out = members.select("member", "class").distinct().join(named, F.col("class") == F.col("node"), "left")
    return out.select("member", "class", F.coalesce("group", "class").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
