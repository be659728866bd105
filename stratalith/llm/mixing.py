"""Sources mixed to target weights by a time-varying curriculum.

Every source has a schedule: its weight at training time u from 0 to 1, linear between knots. The integral of a schedule
is the source's cumulative demand for tokens. Documents of a source stand one after another in a seeded random order,
epoch after epoch; the cumulative tokens before a copy, put into the inverse of the demand, give its training position.
A range sort by position interleaves the sources. Running sums are made in two steps over ranges of the random order, so
a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith import storage
from stratalith.llm import tokens

#: Documents that a range of the random order holds, about; the ranges are a power of two between these.
RANGE_DOCUMENTS, FEWEST, MOST = 65_536, 64, 1 << 24
SLOPE = 0.8
#: Knots of a schedule: training time and weight, in order of time, from 0.0 to 1.0.
Schedule = list[tuple[float, float]]


def name(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def cumulative(knots: Schedule) -> list[tuple[float, float, float, float, float]]:
    """Pieces (start time, its weight, end time, its weight, demand before), scaled to a demand of 1 in all."""
    pieces, total = [], 0.0
    for (u0, w0), (u1, w1) in zip(knots, knots[1:]):
        pieces.append((float(u0), float(w0), float(u1), float(w1), total))
        total += (u1 - u0) * (w0 + w1) / 2
    if not total > 0 or knots[0][0] != 0 or knots[-1][0] != 1 or any(a[0] >= b[0] for a, b in zip(knots, knots[1:])) or any(w < 0 for _, w in knots):
        raise ValueError("a schedule needs increasing times from 0 to 1, weights of at least 0 and a positive integral")
    return [(u0, w0 / total, u1, w1 / total, before / total) for u0, w0, u1, w1, before in pieces]


def invert(pieces: Column, share: Column) -> Column:
    """The time at which the scaled demand reaches ``share``."""
    p = F.element_at(F.filter(pieces, lambda x: (x["before"] <= share) & ((x["w0"] > 0) | (x["w1"] > 0))), -1)
    c = share - p["before"]
    bend = (p["w1"] - p["w0"]) / (p["u1"] - p["u0"])
    root = F.sqrt(F.greatest(p["w0"] * p["w0"] + 2 * bend * c, F.lit(0.0)))
    step = F.when(p["w0"] + root > 0, 2 * c / (p["w0"] + root)).otherwise(0.0)
    return F.least(p["u0"] + step, p["u1"])


#: Totals that follow from the sources: the tokens of all that have a target; or the most at which each meets its share.
COLLECTION, SCARCEST = "collection", "scarcest"


def plan(sources: DataFrame, targets: DataFrame, total: int | str = COLLECTION) -> DataFrame:
    """One row per source of the targets: available, wanted and demanded tokens.

    The total is a number of tokens, ``COLLECTION`` (as many as the sources have; one that can't fill its share within its
    repeats gives all that it may, and the rest of its share is reported as its shortfall) or ``SCARCEST`` (the largest at
    which every source reaches its share within its repeats; most of a large source may stay out). Shares are scaled to 1
    over the sources that exist; the others stay in the report with a demand of 0.
    """
    rows = targets.select(name(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    rows = rows.filter("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = rows.join(sources, "source", "left")
    usable = (F.coalesce("tokens", F.lit(0)) > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    every = Window.partitionBy(F.lit(0))  # sources of the targets, a handful
    rows = rows.withColumn("wanted", F.when(usable, F.col("target_share")).otherwise(0.0))
    rows = rows.withColumn("wanted", F.when(F.sum("wanted").over(every) > 0, F.col("wanted") / F.sum("wanted").over(every)).otherwise(0.0))
    reach = F.when(F.col("wanted") > 0, F.col("tokens") * F.col("max_repeats") / F.col("wanted"))
    every_token = F.sum(F.when(F.col("wanted") > 0, F.col("tokens")).otherwise(0)).over(every).cast("double")
    whole = every_token if total == COLLECTION else F.min(reach).over(every) if total == SCARCEST else F.lit(float(total))
    rows = rows.withColumn("asked", F.coalesce(whole, F.lit(0.0)) * F.col("wanted"))
    demand = F.least("asked", (F.coalesce("tokens", F.lit(0)) * F.col("max_repeats")).cast("double"))
    return rows.withColumn("demand", F.coalesce(demand, F.lit(0.0)))


def default_schedules(rows: list) -> dict[str, Schedule]:
    """Sources of short documents weigh more at first, those of long ones later; at any time all weights make up 1."""
    used = [r for r in rows if r["demand"] > 0]
    whole = sum(r["demand"] for r in used)
    size = {r["source"]: r["tokens"] / r["documents"] for r in used}
    mean = sum(size[r["source"]] * r["demand"] for r in used) / whole if used else 0
    most = max((abs(size[s] - mean) for s in size), default=0) or 1
    slope = {s: SLOPE * (mean - size[s]) / most for s in size}
    return {r["source"]: [(0.0, r["demand"] / whole * (1 + slope[r["source"]])), (1.0, r["demand"] / whole * (1 - slope[r["source"]]))] for r in used}


def mix(
    docs: DataFrame,
    targets: DataFrame,
    total: int | str = COLLECTION,
    schedules: dict[str, Schedule] | None = None,
    seed: int = 7,
    vocabulary: str = tokens.VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """The mixture ``position, source, doc_id, copy_no, n_tokens`` in training order, and the report of shares.

    ``docs`` needs ``doc_id``, ``text`` and ``source``, ``targets`` needs ``source``, ``target_share`` and
    ``max_repeats``; other columns are ignored. Sources compare trimmed and in lower case. Null and blank texts, null ids
    and sources without a target have no row. A repeated id is one document, the one with most tokens. A copy is taken if
    its middle lies before the end of its source's demand, so a demand is met to within half a document. ``total`` is
    explained at :func:`plan`. A null share counts as 0, null repeats as 1. Empty tables give no row. The report keeps
    every target, reached or not, with what it falls short.
    """
    rows = tokens.sized(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), name(F.col("source")).alias("source"), "text"), vocabulary=vocabulary)
    rows = storage.materialize(rows.filter("doc_id is not null and source is not null"), "sized")
    known = targets.select(name(F.col("source")).alias("source")).distinct()
    best = rows.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("d"))
    best = best.select("doc_id", "d.source", "d.n_tokens").join(known, "source", "left_semi")
    best = storage.materialize(best.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")), "chosen")
    bits = min(MOST, max(FEWEST, best.count() // RANGE_DOCUMENTS)).bit_length()
    best = best.withColumn("range", F.shiftrightunsigned("h", 64 - bits).cast("int"))
    ranges = best.groupBy("source", "range").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    sources = ranges.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("documents").alias("documents"))
    planned = storage.materialize(plan(sources, targets, total), "plan")
    # The targets are a list of sources made by hand; a longer one is refused, not broadcast.
    listed = planned.limit(100_001).collect()
    if len(listed) > 100_000:
        raise ValueError("more than 100000 sources in the targets")
    knots = default_schedules(listed) if schedules is None else schedules
    shape = "source string, pieces array<struct<u0 double, w0 double, u1 double, w1 double, before double>>"
    curves = docs.sparkSession.createDataFrame([(s, cumulative(k)) for s, k in knots.items()], shape)
    offset = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = Window.partitionBy("source", "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = best.withColumn("within", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    placed = placed.join(ranges.select("source", "range", offset.alias("offset")), ["source", "range"])
    demanded = planned.filter("demand > 0").select("source", "demand", F.col("tokens").alias("of"), "max_repeats").join(curves, "source")
    placed = placed.join(F.broadcast(demanded), "source")
    epochs = F.least(F.ceil(F.col("demand") / F.col("of")).cast("int"), F.col("max_repeats").cast("int"))
    copies = placed.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.greatest(epochs, F.lit(1)))))
    middle = (F.col("copy_no") - 1) * F.col("of") + F.col("offset") + F.col("within") + F.col("n_tokens") / 2
    copies = copies.withColumn("middle", middle).filter(F.col("middle") < F.col("demand"))
    out = copies.select(invert(F.col("pieces"), F.col("middle") / F.col("demand")).alias("position"), "source", "doc_id", "copy_no", "n_tokens")
    mixture = out.orderBy("position", "source", "doc_id", "copy_no")
    return mixture, shares(out, planned)


def shares(mixture: DataFrame, planned: DataFrame) -> DataFrame:
    """Of each target: its share, the share reached, tokens, documents, the most copies of one document and the tokens it falls short."""
    got = mixture.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.countDistinct("doc_id").alias("mixed_documents"), F.max("copy_no").alias("copies"))
    whole = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))  # one row per target
    rows = planned.join(got, "source", "left").na.fill(0, ["tokens", "documents", "mixed_tokens", "mixed_documents", "copies"])
    reached = F.when(whole > 0, F.col("mixed_tokens") / whole).otherwise(0.0)
    short = F.greatest(F.lit(0), F.round(F.col("asked") - F.col("mixed_tokens")).cast("bigint"))
    return rows.select("source", "target_share", "max_repeats", F.col("wanted").alias("scaled_share"), reached.alias("share_reached"), "tokens", "documents", "mixed_tokens", "mixed_documents", "copies", short.alias("shortfall"))
