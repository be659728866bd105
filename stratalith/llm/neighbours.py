"""The k most similar vectors of every vector, by cross-polytope hashing.

Each of ``TABLES`` tables turns unit vectors by pseudo-rotations (sign flips and fast Hadamard transforms) and names the
nearest signed axis. A row is stored in the cell of its axis. As a query it also probes the cell of the runner-up axis if
that is nearly as near (``PROBE_GAP``). Cells over ``CELL_ROWS`` rows are split by further rotations of the same table, as long
as there are any; a cell that ``LEVELS`` rotations can't split is worked through in pairs of blocks, which loses nothing.
Which cells are split is a table that rows are joined with by path, so the rule is the same at every size.
Rows whose cells hold too few others are searched exactly among all rows of their model, in pairs of blocks.
Within a cell all similarities are computed by matrix products and the best are ranked exactly, in double precision.

Counts of cells come from all rows. More than ``SMALL`` members with one and the same vector are represented by the
first ``SMALL``; the other members' nearest are the first k of their class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalith import storage

TABLES, LEVELS, PROBE_GAP, CELL_ROWS = 3, 5, 0.1, 8192
TILE = 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def nearest_axes(unit: np.ndarray, table: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of the nearest signed axis, of the runner-up, and by how much the latter is farther, as a share."""
    d = 1 << (unit.shape[1] - 1).bit_length()
    y = np.pad(unit, ((0, 0), (0, d - unit.shape[1])))
    signs = np.random.default_rng([table, level]).choice([-1.0, 1.0], size=(3, d)).astype(unit.dtype)
    for s in signs:
        y = hadamard(y * s)
    a, at = np.abs(y), np.arange(len(y))
    first = a.argmax(axis=1)
    most = a[at, first].copy()
    a[at, first] = -1
    second = a.argmax(axis=1)
    code = lambda j: 2 * j + (y[at, j] > 0)
    return code(first), code(second), 1 - a[at, second] / most


def usable(batch: pa.RecordBatch, dims: int):
    """Row numbers and float64 vectors with ``dims`` finite components, not all zero."""
    column = batch.column(batch.schema.get_field_index("vector"))
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dims)
    if not len(rows):
        return rows, np.zeros((0, dims))
    flat = column.take(pa.array(rows)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return rows[ok], x[ok]


def _paths(unit: np.ndarray, table: int, levels: int = LEVELS):
    """Cell paths at each level: ``own[level]`` and ``probes``, a list of (rows, paths by level)."""
    codes = [nearest_axes(unit, table, level) for level in range(levels)]
    own, path = [], np.zeros(len(unit), np.int64)
    for c, _, _ in codes:
        path = path * 4096 + c
        own.append(path)
    probes = []
    for j, (_, second, gap) in enumerate(codes):
        rows = np.flatnonzero(gap < PROBE_GAP)
        paths, path = [], np.zeros(len(rows), np.int64)
        for level, (c, _, _) in enumerate(codes):
            path = path * 4096 + (second[rows] if level == j else c[rows])
            paths.append(path)
        probes.append((rows, paths))
    return own, probes


def _by_model(batch: pa.RecordBatch, dims: int):
    rows, x = usable(batch, dims)
    models = np.array(batch.column(batch.schema.get_field_index("vector_model")).take(pa.array(rows)).to_pylist(), dtype=object)
    for model in dict.fromkeys(models):
        own = models == model
        yield model, rows[own], x[own]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


COUNTS = "vector_model string, place int, path bigint, n bigint"


def _counts(dims: int, level: int):
    """How many rows of a batch lie in each cell of a level."""

    def run(batches):
        for batch in batches:
            for model, _, x in _by_model(batch, dims):
                unit = _unit(x).astype(np.float32)
                for table in range(TABLES):
                    values, n = np.unique(_paths(unit, table, level + 1)[0][level], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"vector_model": pa.array([model] * len(n), pa.string()), "place": pa.array(np.full(len(n), table, np.int32)), "path": pa.array(values), "n": pa.array(n)})

    return run


def oversized(rows: DataFrame, dims: int, cap: int) -> list[DataFrame]:
    """Of each level that is needed, the cells of more than ``cap`` rows: ``vector_model, place, path, n``.

    A cell over the cap lies within one of the level above. The last level is the first without such cells, or ``LEVELS``.
    """
    out: list[DataFrame] = []
    for level in range(LEVELS):
        counts = rows.mapInArrow(_counts(dims, level), COUNTS).groupBy("vector_model", "place", "path").agg(F.sum("n").alias("n"))
        cells = storage.materialize(counts.filter(F.col("n") > cap), "cells")
        if cells.isEmpty():
            break
        out.append(cells)
    return out


def _fixed(raw: np.ndarray) -> pa.Array:
    """Vectors as binary values."""
    width = raw.shape[1] * raw.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(raw), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def _rows(dims: int, levels: int):
    """Every row once per table in its own cell (``probe`` 0), and once in each cell that it probes by the runner-up of a level."""

    def run(batches):
        for batch in batches:
            for model, rows, x in _by_model(batch, dims):
                child = batch.column(batch.schema.get_field_index("child_no")).take(pa.array(rows)).to_numpy()
                raw = np.ascontiguousarray(x.astype(np.float32))
                unit = _unit(x).astype(np.float32)
                for table in range(TABLES):
                    own, probes = _paths(unit, table, levels)
                    for probe, (r, paths) in enumerate([(np.arange(len(rows)), own), *probes]):
                        if len(r):
                            head = {"vector_model": pa.array([model] * len(r), pa.string()), "place": pa.array(np.full(len(r), table, np.int32)), "probe": pa.array(np.full(len(r), probe, np.int32))}
                            yield pa.RecordBatch.from_pydict(head | {f"p{j}": pa.array(p) for j, p in enumerate(paths)} | {"child_no": pa.array(child[r]), "vector": _fixed(raw[r])})

    return run


CELL = ("vector_model", "place", "level", "path", "query_block", "base_block")


def placed(rows: DataFrame, over: list[DataFrame], dims: int) -> DataFrame:
    """Rows in their cells: ``CELL``, ``role`` (1 base, 2 query, 3 both), ``child_no``, ``vector``.

    A row goes down as many levels as its path has cells over the cap. A probe counts where its level is reached; above, it
    is the row's own cell. In cells over the cap at the last level queries meet each block of base rows.
    """
    levels = min(len(over) + 1, LEVELS)
    shape = ["vector_model string", "place int", "probe int", *(f"p{j} bigint" for j in range(levels)), "child_no bigint", "vector binary"]
    out = rows.mapInArrow(_rows(dims, levels), ", ".join(shape))
    for j, cells in enumerate(over):
        out = out.join(cells.withColumnsRenamed({"path": f"p{j}", "n": f"n{j}"}), ["vector_model", "place", f"p{j}"], "left")
    level = sum((F.col(f"n{j}").isNotNull().cast("int") for j in range(min(len(over), LEVELS - 1))), F.lit(0))
    path = F.coalesce(*(F.when(F.col("level") == j, F.col(f"p{j}")) for j in range(levels)))
    out = out.withColumn("level", level).filter("probe <= level + 1").withColumn("path", path)
    role = F.when(F.col("probe") == 0, 3).otherwise(2)
    if len(over) < LEVELS:
        none = F.lit(0)
        return out.select(*CELL[:4], none.alias("query_block"), none.alias("base_block"), role.alias("role"), "child_no", "vector")
    blocks = F.coalesce(F.ceil(F.col(f"n{LEVELS - 1}") / CELL_ROWS), F.lit(1)).cast("int")
    mine, every = F.pmod(F.xxhash64("child_no"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    copy = lambda q, b, r: F.struct(q.alias("query_block"), b.alias("base_block"), r.cast("int").alias("role"))
    asks, stands = F.transform(every, lambda b: copy(F.col("mine"), b, F.lit(2))), F.transform(every, lambda b: copy(b, F.col("mine"), F.lit(1)))
    zero = F.lit(0)
    copies = F.when(F.col("blocks") == 1, F.array(copy(zero, zero, role))).when(F.col("probe") > 0, asks).otherwise(F.concat(asks, stands))
    out = out.withColumn("blocks", blocks).withColumn("mine", mine).withColumn("c", F.explode(copies))
    return out.select(*CELL[:4], "c.*", "child_no", "vector")


def top(query: np.ndarray, q_id: np.ndarray, base: np.ndarray, b_id: np.ndarray, k: int):
    """Ids and similarities of the k most similar base rows of each query, itself left out; ties to the smaller id.

    A product of unit vectors narrows the choice to a few; their cosines, in double precision and rounded to 12 digits,
    rank them. Where more rows than that are as near as the k-th, all rows of the cell are ranked.
    """
    unit, bn = _unit(base), np.sqrt((base * base).sum(axis=1))
    order = np.argsort(b_id, kind="stable")
    sorted_ids = b_id[order]
    for lo in range(0, len(query), TILE):
        q, ids = query[lo : lo + TILE], q_id[lo : lo + TILE]
        s = _unit(q) @ unit.T
        at = np.searchsorted(sorted_ids, ids)
        own = np.flatnonzero((at < len(sorted_ids)) & (sorted_ids[np.minimum(at, len(sorted_ids) - 1)] == ids))
        s[own, order[at[own]]] = -3
        m = min(k + 11, s.shape[1])
        best = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < s.shape[1] else np.broadcast_to(np.arange(m), s.shape)
        qn = np.sqrt((q * q).sum(axis=1))
        rows = np.arange(len(q))[:, None]

        def nearest_of(rows, best):
            exact = np.round(np.einsum("ij,imj->im", q[rows], base[best]) / (qn[rows, None] * bn[best]), 12)
            near = b_id[best]
            exact[near == ids[rows][:, None]] = -3
            rank = np.lexsort((near, -exact))[:, :k]
            i = np.arange(len(rows))[:, None]
            return near[i, rank], exact[i, rank]

        near, exact = nearest_of(rows[:, 0], best)
        if m < s.shape[1]:
            tied = np.flatnonzero((s >= exact[:, -1:] - 2e-12).sum(axis=1) > m)
            for i in tied:  # one by one, as a cell may be large
                near[i], exact[i] = (x[0] for x in nearest_of(np.array([i]), np.arange(s.shape[1])[None, :]))
        yield ids, near, exact


FOUND = "child_no bigint, near array<struct<far double, id bigint>>"


def _cell(k: int, dims: int):
    def run(key, table):
        role, child = table.column("role").to_numpy(), table.column("child_no").to_numpy()
        x = np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype=np.float32).reshape(-1, dims).astype(np.float64)
        base, query = (np.flatnonzero(role & bit) for bit in (1, 2))
        base, query = (r[np.unique(child[r], return_index=True)[1]] for r in (base, query))
        ids, far, near, sizes = [], [], [], []
        if len(base) and len(query):
            for i, n, c in top(x[query], child[query], x[base], child[base], k):
                ok = c > -2
                ids.append(i), far.append(-c[ok]), near.append(n[ok]), sizes.append(ok.sum(axis=1))
        cat = lambda parts, t: np.concatenate(parts).astype(t) if parts else np.zeros(0, t)
        offsets = np.concatenate([[0], np.cumsum(cat(sizes, np.int64))]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(cat(far, np.float64)), pa.array(cat(near, np.int64))], names=["far", "id"])
        return pa.table({"child_no": pa.array(cat(ids, np.int64)), "near": pa.ListArray.from_arrays(pa.array(offsets), pairs)})

    return run


PACKED = "vector_model string, child_no bigint, vector binary"


def _packed(dims: int):
    def run(batches):
        for batch in batches:
            for model, rows, x in _by_model(batch, dims):
                child = batch.column(batch.schema.get_field_index("child_no")).take(pa.array(rows))
                yield pa.RecordBatch.from_pydict({"vector_model": pa.array([model] * len(rows), pa.string()), "child_no": child, "vector": _fixed(np.ascontiguousarray(x.astype(np.float32)))})

    return run


def _exact(rows: DataFrame, short: DataFrame, k: int, dims: int) -> DataFrame:
    """The nearest of the rows named by ``short``, among all rows of their model: every pair of blocks of both."""
    few = lambda df: F.broadcast(df) if df.count() <= 100_000 else df
    named = storage.materialize(rows.join(short, "child_no", "left_semi").select("vector_model", "child_no").distinct(), "short")
    packed = rows.select("vector_model", "child_no", "vector").mapInArrow(_packed(dims), PACKED)
    sizes = packed.groupBy("vector_model").agg(F.count("*").alias("n_rows")).join(named.groupBy("vector_model").agg(F.count("*").alias("n_short")), "vector_model")
    blocks = lambda n: F.ceil(F.col(n) / CELL_ROWS).cast("int")
    sizes = storage.materialize(sizes.select("vector_model", blocks("n_rows").alias("nb"), blocks("n_short").alias("nq")), "blocks")
    mine = lambda n: F.pmod(F.xxhash64("child_no"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = packed.join(few(sizes), "vector_model")
    query = placed.join(few(named), ["vector_model", "child_no"], "left_semi").withColumn("path", mine("nq")).withColumn("blocks", every("nb")).withColumn("role", F.lit(2))
    base = placed.withColumn("blocks", mine("nb")).withColumn("path", every("nq")).withColumn("role", F.lit(1))
    both = query.unionByName(base).select("vector_model", F.col("path").cast("bigint").alias("path"), "blocks", "role", "child_no", "vector")
    return both.groupBy("vector_model", "path", "blocks").applyInArrow(_cell(k, dims), FOUND)


def _merged(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("child_no").agg(F.flatten(F.collect_list("near")).alias("near"))
    return best.select("child_no", F.slice(F.array_distinct(F.sort_array("near")), 1, k).alias("near"))


def finite_nonzero(dims: int):
    v = F.col("vector")
    return (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def nearest(spans: DataFrame, k: int = 5, dims: int = 64, cell_rows: int | None = None) -> DataFrame:
    """``child_no, near`` with ``near`` an array of up to ``k`` structs (``id``, ``similarity``), nearest first.

    ``spans`` needs ``child_no``, ``vector`` and ``vector_model``; other columns are ignored. Only vectors of the same
    model compare. Rows have no result, and are nobody's neighbour, if the id or model is null or the vector is null, of
    another length, not finite or all zero. Repeated rows count once; of an id's several usable vectors the one with the
    least hash (of model and vector) counts. A row without any other of its model has no result. Ties go to the smaller id.
    """
    cap = cell_rows or CELL_ROWS
    rows = spans.select(F.col("child_no").cast("bigint").alias("child_no"), "vector_model", F.col("vector").cast("array<float>").alias("vector"))
    rows = rows.filter("child_no is not null and vector_model is not null")
    small = k + 1
    keyed = rows.withColumn("ck", F.xxhash64("vector_model", "vector"))
    sized = keyed.filter(F.size("vector") == dims)
    several = sized.groupBy("child_no").agg(F.min("ck").alias("a"), F.max("ck").alias("b")).filter("a < b").select("child_no")
    several = storage.materialize(several, "several")
    n_several = several.count()
    if n_several:  # ids with different vectors: one of their usable ones counts
        few = F.broadcast if n_several <= 100_000 else (lambda df: df)
        chosen = sized.join(few(several), "child_no").filter(finite_nonzero(dims)).groupBy("child_no").agg(F.min("ck").alias("ck"))
        chosen = storage.materialize(chosen, "chosen")
        keyed = keyed.join(few(several), "child_no", "left_anti").unionByName(keyed.join(few(chosen), ["child_no", "ck"], "left_semi"))
        rows, sized = keyed.drop("ck"), keyed.filter(F.size("vector") == dims)
    hot = storage.materialize(sized.groupBy("ck").count().filter(F.col("count") > small).select("ck"), "copies")
    n_hot, rest = hot.count(), None
    if n_hot:
        few = F.broadcast if n_hot <= 100_000 else (lambda df: df)
        members = keyed.join(few(hot), "ck").filter(finite_nonzero(dims)).select("ck", "child_no").distinct()
        members = storage.materialize(members, "members")
        rank = F.row_number().over(Window.partitionBy("ck").orderBy("child_no"))
        heads = storage.materialize(members.withColumn("rank", rank).filter(F.col("rank") <= small), "heads")
        others = storage.materialize(members.join(heads.select("child_no"), "child_no", "left_anti"), "others")
        first = heads.filter(F.col("rank") <= k).groupBy("ck").agg(F.sort_array(F.collect_list(F.struct(F.lit(-1.0).alias("far"), F.col("child_no").alias("id")))).alias("near"))
        rest = others.join(few(first), "ck").select("child_no", "near")
        rows = rows.join(others.select("child_no"), "child_no", "left_anti")
    found = placed(rows, oversized(rows, dims, cap), dims).groupBy(*CELL).applyInArrow(_cell(k, dims), FOUND)
    if rest is not None:
        found = found.unionByName(rest)
    best = storage.materialize(_merged(found, k), "best")  # has every row, as it is found in its own cell, if only with no others
    short = best.filter(F.size("near") < k).select("child_no")
    if not short.isEmpty():
        # other members of a copied vector are no loss: its first k + 1 are all that can be among the nearest
        whole = _merged(_exact(rows, short, k, dims), k)
        best = best.filter(F.size("near") >= k).unionByName(whole)
    best = best.filter(F.size("near") > 0)
    return best.select("child_no", F.transform("near", lambda x: F.struct(x["id"].alias("id"), (-x["far"]).alias("similarity"))).alias("near"))


def exact_nearest(spans: DataFrame, queries: DataFrame, k: int = 5, dims: int = 64) -> DataFrame:
    """``child_no, near`` as :func:`nearest`, without loss, for the rows that ``queries`` (``child_no``) names."""
    rows = spans.select(F.col("child_no").cast("bigint").alias("child_no"), "vector_model", F.col("vector").cast("array<float>").alias("vector"))
    rows = rows.filter("child_no is not null and vector_model is not null")
    best = _merged(_exact(rows, queries.select("child_no"), k, dims), k)
    return best.select("child_no", F.transform("near", lambda x: F.struct(x["id"].alias("id"), (-x["far"]).alias("similarity"))).alias("near"))


def links(near: DataFrame) -> DataFrame:
    """Unordered pairs of which one is among the nearest of the other: ``child_a`` < ``child_b``."""
    pairs = near.select("child_no", F.explode("near.id").alias("other"))
    return pairs.select(F.least("child_no", "other").alias("child_a"), F.greatest("child_no", "other").alias("child_b")).distinct()
