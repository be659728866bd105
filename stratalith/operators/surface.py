"""Token budgets of the visible surface: pressure, eviction order, running budgets, manifest tree."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalith.config import Config
from stratalith.functions import text


def budget(total: Column, window: Column, output: Column, cap: Column, config: Config = Config()) -> Column:
    """Struct ``usable, pressure, triggered, threshold, target``."""
    usable = F.coalesce(cap, F.greatest(F.lit(1), window - output))
    return F.struct(
        usable.alias("usable"), (total / usable).alias("pressure"), (total / usable >= config.context_pressure_ratio).alias("triggered"),
        F.floor(usable * config.context_pressure_ratio).alias("threshold"), F.floor(usable * config.context_target_ratio).alias("target"),
    )


def injection(usable: Column, used: Column, snapshot: Column, config: Config = Config()) -> Column:
    """Struct ``headroom, semi, evidence``: tokens for the snapshot and for evidence."""
    headroom = F.greatest(F.lit(0), F.floor(usable * config.context_pressure_ratio) - used)
    return F.struct(headroom.alias("headroom"), F.least(F.floor(usable * config.semi_budget_ratio), headroom).alias("semi"), F.greatest(F.lit(0), F.least(F.floor(usable * config.evidence_budget_ratio), headroom - snapshot)).alias("evidence"))


def eviction(segments: DataFrame, usable: Column, current_turn: Column, config: Config = Config(), checkpoint_tokens: int = 80) -> DataFrame:
    """``rank`` and ``evicted`` of each segment of ``session_id, turn, tokens, first_seq``.

    Cold segments (inactive for some turns) go first, then long inactive, then large ones. Each one frees its tokens less
    those of a checkpoint; eviction starts at the pressure ratio and stops once the session is at or below its target.
    A session is one group here; its segments are one small row per turn.
    """
    rows = segments.withColumn("inactive", current_turn - F.col("turn")).withColumn("cold", F.col("inactive") >= config.working_inactive_turns)
    order = Window.partitionBy("session_id").orderBy(F.desc("cold"), F.desc("inactive"), F.desc("tokens"), "first_seq", "turn")
    total = F.sum("tokens").over(Window.partitionBy("session_id"))
    freed = F.coalesce(F.sum(F.greatest(F.lit(0), F.col("tokens") - checkpoint_tokens)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    limit = budget(total, F.lit(config.context_window), F.lit(config.max_output_tokens), usable, config)
    rows = rows.withColumn("rank", F.row_number().over(order)).withColumn("total", total).withColumn("before", total - freed).withColumn("b", limit)
    return rows.withColumn("evicted", F.col("b.triggered") & (F.col("before") > F.col("b.target"))).drop("b", "before")


def skipping(items: DataFrame, group: list[str], order: list[str], cost: Column, limit: Column) -> DataFrame:
    """``accepted`` of each item: it is taken if it still fits; one that doesn't is passed over and later ones are tried.

    What is taken depends on all items before, so a group is read in order by one task; it is streamed, not gathered. An
    item of unknown cost isn't taken.
    """
    rows = items.withColumn("__cost", cost.cast("bigint")).withColumn("__limit", limit.cast("bigint"))
    rows = rows.repartition(*group).sortWithinPartitions(*group, *order)
    at = [rows.columns.index(g) for g in group]

    def run(batches):
        last, used = None, 0
        for batch in batches:
            n = len(batch.schema)
            keys, taken = zip(*(batch.column(i).to_pylist() for i in at)), []
            for key, c, most in zip(keys, batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist()):
                if key != last:
                    last, used = key, 0
                fits = c is not None and most is not None and used + c <= most
                used += c if fits else 0
                taken.append(fits)
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], pa.array(taken, pa.bool_())], names=[*batch.schema.names[: n - 2], "accepted"])

    return rows.mapInArrow(run, T.StructType([*items.schema.fields, T.StructField("accepted", T.BooleanType())]))


def stopping(items: DataFrame, group: list[str], order: list[Column], cost: Column, limit: Column) -> DataFrame:
    """``accepted`` of each item: all before the first that doesn't fit; the first item always."""
    w = Window.partitionBy(*group).orderBy(*order)
    used = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(w) == 1
    rows = items.withColumn("__over", F.when(first, F.lit(False)).otherwise(used > limit))
    return rows.withColumn("accepted", ~F.max("__over").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__over")


def manifest(segments: DataFrame, fanout: int = 4) -> DataFrame:
    """Tree over a session's segments: ``session_id, level, node, first_seq, last_seq, labels``, up to one root.

    A node's place follows from its first segment's, so levels are one explode and one aggregate, not a loop.
    """
    w = Window.partitionBy("session_id").orderBy("first_seq", "segment_id")
    rows = segments.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("session_id")))
    top = F.when(F.col("n") > 1, F.ceil(F.log(F.col("n").cast("double")) / F.log(F.lit(float(fanout))) - 1e-9)).otherwise(0).cast("int")
    rows = rows.withColumn("level", F.explode(F.sequence(F.lit(0), top))).withColumn("node", F.floor(F.col("i") / F.pow(F.lit(fanout), F.col("level"))).cast("bigint"))
    label = F.when(F.col("i") < F.col("node") * F.pow(F.lit(fanout), F.col("level")) + 2, F.struct("i", "label"))
    out = rows.groupBy("session_id", "level", "node").agg(F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.collect_list(label).alias("l"))
    return out.select("session_id", "level", "node", "first_seq", "last_seq", F.transform(F.array_sort("l"), lambda x: x["label"]).alias("labels"))


def request_attributes(messages: DataFrame) -> DataFrame:
    """Messages, characters and tokens of each session by role and source, with totals."""
    rows = messages.withColumn("chars", F.length(text.nonblank(F.col("text")))).withColumn("tokens", text.estimate_tokens(F.col("text")))
    out = rows.groupBy(F.col("session_id"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("source_kind", F.lit("unknown")).alias("source_kind"))
    return out.agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))


def snapshot_action(previous: Column, current: Column) -> Column:
    """What becomes of a session's snapshot message, by its old and new revision (null: none)."""
    return F.when(previous.isNull() & current.isNull(), "none").when(previous.isNull(), "insert").when(current.isNull(), "supersede-to-empty").when(previous == current, "reuse").otherwise("supersede-and-insert")


def replacements(requests: DataFrame, segments: DataFrame, applied: DataFrame) -> DataFrame:
    """Replacement events for segments: ``session_id, segment_id, seq, start, end, text`` of requests that hold.

    ``requests`` has ``session_id, segment_id, revision, text``, ``segments`` also ``revision, first_seq, last_seq``. A
    request for another revision is refused, one whose range was replaced already is passed over. ``seq`` follows the
    session's last number.
    """
    rows = requests.join(segments, ["session_id", "segment_id", "revision"]).filter("first_seq <= last_seq")
    done = applied.select("session_id", F.col("start").alias("first_seq"), F.col("end").alias("last_seq"))
    rows = rows.join(done, ["session_id", "first_seq", "last_seq"], "left_anti")
    last = segments.groupBy("session_id").agg(F.max("last_seq").alias("last"))
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("first_seq", "segment_id"))
    rows = rows.join(last, "session_id").withColumn("seq", F.col("last") + n)
    return rows.select("session_id", "segment_id", "seq", F.col("first_seq").alias("start"), F.col("last_seq").alias("end"), "text")


def with_injections(messages: DataFrame, injections: DataFrame) -> DataFrame:
    """Messages in order, with a session's manifest, snapshot and catalog right before its last user message.

    ``injections`` has ``session_id, purpose, text``; sessions without a user message get them at the end.
    """
    order = F.create_map(*(F.lit(x) for pair in (("sensory-root-manifest", 0), ("semipersistent-snapshot", 1), ("sensory-catalog", 2)) for x in pair))
    claimed = messages.groupBy("session_id").agg(F.max(F.when((F.col("role") == "user") & (F.coalesce("source_kind", F.lit("user")) != "plugin"), F.col("seq"))).alias("claimed"), F.max("seq").alias("last"))
    extra = injections.filter("text is not null").join(claimed, "session_id")
    extra = extra.select("session_id", F.coalesce(F.col("claimed"), F.col("last") + 1).alias("seq"), F.coalesce(order[F.col("purpose")], F.lit(2)).alias("place"), F.lit("user").alias("role"), F.lit("plugin").alias("source_kind"), "text")
    own = messages.select("session_id", "seq", F.lit(9).alias("place"), "role", "source_kind", "text")
    return own.unionByName(extra).orderBy("session_id", "seq", "place")


def injected_evidence(items: DataFrame, max_tokens: Column, observation: Column) -> DataFrame:
    """``query_id, evidence``: whole parents in order of ``pick`` that fit beside the observation, joined by blank lines."""
    rows = items.withColumn("limit", F.greatest(F.lit(0), max_tokens - text.estimate_tokens(observation) - 32))
    kept = skipping(rows, ["query_id"], ["pick"], text.estimate_tokens(F.col("view")) + 24, F.col("limit")).filter("accepted")
    parts = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pick", "view"))).alias("p"))
    return parts.select("query_id", F.array_join(F.transform("p", lambda x: x["view"]), "\n\n").alias("evidence"))
