"""Containers of a fixed capacity, filled by patterns that non-negative least squares fits to the histogram of sizes.

The driver sees the histogram only: at most ``capacity`` counts, however many items there are. It enumerates patterns of
up to ``PATTERN_ITEMS`` items whose size classes fill a container, fits their repeat counts, rounds them, turns classes
into exact sizes, and packs what is left best-fit into the remaining room, all in counts of like containers. The result
is a table of slots, whose size depends on the capacity. Items find their slot by size and by rank among items of that
size; ranks are counted in groups of about ``GROUP`` items, so that a size shared by a third of all items is spread over
tasks, however many there are.
"""

from __future__ import annotations

import warnings
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalith import storage
from stratalith.llm import tokens

CLASSES, PATTERN_ITEMS, GROUP = 64, 4, 65_536


def patterns(classes: int = CLASSES, items: int = PATTERN_ITEMS) -> list[tuple[int, ...]]:
    """Non-increasing tuples of up to ``items`` size classes with the sum ``classes``."""
    out: list[tuple[int, ...]] = []

    def grow(prefix: tuple[int, ...], left: int) -> None:
        if not left:
            out.append(prefix)
        elif len(prefix) < items:
            for c in range(min(left, prefix[-1] if prefix else left), 0, -1):
                if c * (items - len(prefix)) >= left:
                    grow((*prefix, c), left - c)

    grow((), classes)
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x >= 0 that minimises |a x - b|, by active sets (Lawson and Hanson).

    Stopped before the optimum, it warns: the patterns then cover less, and best fit packs the rest.
    """
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, np.abs(a.T @ b).max(initial=0))
    for _ in range(3 * a.shape[0] + 50):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= tolerance:
            break
        active[j] = True
        while True:
            cols = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[cols] = z
                break
            low = z <= 0
            step = np.min(x[cols][low] / np.maximum(x[cols][low] - z[low], 1e-300))
            x[cols] += step * (z - x[cols])
            x[cols[(x[cols] <= 1e-12) & low]] = 0
            gone = cols[x[cols] <= 1e-12]
            if not len(gone):
                break
            active[gone] = False
            x[gone] = 0
    else:
        warnings.warn("the fit of patterns stopped before its optimum", stacklevel=2)
    return x


def fit(sizes: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Groups of like containers: (sizes of their items, number of containers). Every item of ``sizes`` is in one."""
    left = dict(sizes)
    classes = min(CLASSES, capacity)
    class_of = {s: -(-s * classes // capacity) for s in left}
    stock: dict[int, list[int]] = defaultdict(list)
    for s in sorted(left):
        stock[class_of[s]].append(s)
    have = np.zeros(classes)
    for s, n in left.items():
        have[class_of[s] - 1] += n
    names = [p for p in patterns(classes) if all(have[c - 1] for c in p)]
    groups: list[tuple[tuple[int, ...], int]] = []
    if names:
        a = np.zeros((classes, len(names)))
        for j, p in enumerate(names):
            for c in p:
                a[c - 1, j] += 1
        weight = np.arange(1, classes + 1)[:, None] / classes  # a long item left over costs more than a short one
        x = nnls(a * weight, have * weight[:, 0])
        room = sorted(left)
        for j in sorted(np.flatnonzero(x > 0.5), key=lambda j: (-names[j][0], j)):
            groups += exact(names[j], round(x[j]), stock, left, room, capacity)
    return best_fit(groups, left, capacity)


def exact(pattern: tuple[int, ...], times: int, stock: dict[int, list[int]], left: dict[int, int], sizes: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Up to ``times`` containers of a pattern with exact sizes: the largest of each class, and last what fits best."""
    out = []
    while times > 0:
        items, n = [], times
        for c in pattern[:-1]:
            while stock[c] and not left[stock[c][-1]]:
                stock[c].pop()
            if not stock[c]:
                n = 0
                break
            s = stock[c][-1]
            left[s] -= n if left[s] >= n else (n := left[s])
            items.append((s, n))
        if n and len({k for _, k in items}) > 1:  # a later size had fewer: give the surplus of the earlier ones back
            for s, k in items:
                left[s] += k - n
        room = capacity - sum(s for s, _ in items)
        i = bisect_right(sizes, room) - 1 if n else -1
        while i >= 0 and not left[sizes[i]]:
            sizes.pop(i)
            i -= 1
        if i < 0:
            for s, k in items:
                left[s] += n if n else k
            break
        k = min(n, left[sizes[i]])
        left[sizes[i]] -= k
        for s, _ in items:
            left[s] += n - k
        out.append((tuple(s for s, _ in items) + (sizes[i],), k))
        times -= k
    return out


def best_fit(groups: list[tuple[tuple[int, ...], int]], left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Put the remaining sizes, largest first, where the least room is left over; open containers where none fits."""
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    free: list[int] = []

    def put(room: int, group: tuple[tuple[int, ...], int]) -> None:
        if not rooms[room]:
            insort(free, room)
        rooms[room].append(group)

    for group in groups:
        put(capacity - sum(group[0]), group)
    for s in sorted((s for s, n in left.items() if n), reverse=True):
        n = left[s]
        while n:
            i = bisect_left(free, s)
            if i == len(free):
                each = capacity // s
                if n // each:
                    put(capacity - each * s, ((s,) * each, n // each))
                if n % each:
                    put(capacity - (n % each) * s, ((s,) * (n % each), 1))
                break
            room = free[i]
            items, count = rooms[room].pop()
            if not rooms[room]:
                free.pop(i)
            k = min(n, count)
            if k < count:
                put(room, (items, count - k))
            put(room - s, ((*items, s), k))
            n -= k
    return [g for room in free for g in rooms[room]]


def slots(groups: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Of each size: first rank, first container, place and start of its runs of slots, in order of rank."""
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    first = 0
    for items, count in sorted(groups, key=lambda g: (-sum(g[0]), g)):
        start = 0
        for place, s in enumerate(items):
            runs[s].append((used[s], first, place, start))
            used[s] += count
            start += s
        first += count
    return {s: tuple(np.array(r, np.int64).T) for s, r in runs.items()}


def capacity_of(kinds: DataFrame, kind: str) -> int:
    rows = kinds.filter(F.col("container_kind") == kind).agg(F.max("capacity_tokens")).collect()
    if rows[0][0] is None or rows[0][0] < 1:
        raise ValueError(f"no capacity for container kind {kind!r}")
    return int(rows[0][0])


PACKED = "container_no bigint, place int, start_token int, doc_id bigint, piece_no int, first_token bigint, n_tokens bigint"


def pack(docs: DataFrame, capacity: int, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """Every non-blank text in a container: ``container_no, place, start_token, doc_id, piece_no, first_token, n_tokens``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A text over the capacity is cut into full pieces
    and a rest (``piece_no`` from 0, ``first_token`` within the text); no other text is cut. ``start_token`` is the
    place of the piece within its container. Null and blank texts are left out; repeated rows, ids and null ids are
    items of their own. An empty table gives no row.
    """
    items = tokens.sized(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), vocabulary=vocabulary)
    full = F.floor(F.col("n_tokens") / capacity).cast("int")
    last = F.when(F.col("n_tokens") % capacity == 0, full - 1).otherwise(full)
    items = items.withColumn("piece_no", F.explode(F.sequence(F.lit(0), last)))
    first = F.col("piece_no").cast("bigint") * capacity
    items = items.select("doc_id", "piece_no", first.alias("first_token"), F.least(F.col("n_tokens") - first, F.lit(capacity)).alias("n_tokens"))
    # Items of null id are spread by their row; what is written once keeps its place.
    spread = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "piece_no")).otherwise(F.xxhash64(F.monotonically_increasing_id()))
    items = storage.materialize(items.withColumn("h", spread), "items")
    sizes = {r[0]: r[1] for r in items.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    table = items.sparkSession.sparkContext.broadcast(slots(fit(sizes, capacity)))  # so is this bounded by the capacity
    salts = items.sparkSession.createDataFrame([(s, -(-n // GROUP)) for s, n in sizes.items()], "n_tokens bigint, salts bigint")
    salted = items.join(F.broadcast(salts), "n_tokens").withColumn("salt", F.pmod("h", "salts")).drop("salts")
    counts = salted.groupBy("n_tokens", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = storage.materialize(counts.select("n_tokens", "salt", before.alias("before")), "sizes")
    rank = F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece_no", "h")) - 1
    ranked = salted.withColumn("rank", rank).join(counts, ["n_tokens", "salt"])
    ranked = ranked.select("doc_id", "piece_no", "first_token", "n_tokens", (F.col("rank") + F.col("before")).alias("rank"))

    def run(batches):
        for batch in batches:
            size, rank = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            found = np.zeros((3, len(size)), np.int64)
            order = np.argsort(size, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
                if len(part):
                    first, container, place, start = table.value[int(size[part[0]])]
                    i = np.searchsorted(first, rank[part], side="right") - 1
                    found[:, part] = container[i] + rank[part] - first[i], place[i], start[i]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[0]), pa.array(found[1].astype(np.int32)), pa.array(found[2].astype(np.int32)), *(batch.column(i) for i in range(4))],
                names=[c.split()[0] for c in PACKED.split(", ")],
            )

    return ranked.mapInArrow(run, PACKED)


def checked(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: documents packed, containers over the capacity, containers with a gap or an overlap, and items cut without need."""
    inside = packed.groupBy("container_no").agg(F.sum("n_tokens").alias("used"), F.array_sort(F.collect_list(F.struct("start_token", "n_tokens"))).alias("items"))
    meets = F.aggregate("items", F.lit(0).cast("bigint"), lambda at, x: F.when(x["start_token"] == at, at + x["n_tokens"]).otherwise(F.lit(-(1 << 40)))) == F.col("used")
    boxes = inside.agg(F.count_if(F.col("used") > capacity).alias("over_capacity"), F.count_if(~meets).alias("misplaced"))
    items = packed.agg(F.count_if(F.col("piece_no") == 0).alias("n_documents"), F.count_if((F.col("piece_no") > 0) & (F.col("first_token") % capacity > 0)).alias("cut_early"))
    return items.join(boxes).select("n_documents", "over_capacity", "misplaced", "cut_early")  # one row each


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """``n_items, used_tokens, unused_tokens`` of each ``container_no``."""
    out = packed.groupBy("container_no").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("used_tokens"))
    return out.withColumn("unused_tokens", F.lit(capacity) - F.col("used_tokens"))
