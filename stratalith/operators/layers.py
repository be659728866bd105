"""Layers above the ledger: workspace records and their projections, the bank, supersession, cascades, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.functions import text, vector

GLOBAL_SCOPE = "user-global"


def bank_visible(bank: DataFrame, workspace: Column | str) -> DataFrame:
    """Verified, current, not soft-deleted and not superseded records of the workspace and of the user."""
    own = (F.col("scope_kind") == "workspace") & (F.col("scope_id") == (F.lit(workspace) if isinstance(workspace, str) else workspace))
    wide = F.col("scope_kind") == GLOBAL_SCOPE
    if "superseded_by" in bank.columns:
        bank = bank.filter("superseded_by is null")
    return bank.filter((own | wide) & F.coalesce("verified", F.lit(False)) & F.coalesce("current", F.lit(True)) & F.col("tombstoned_at").isNull())


def bank_search(bank: DataFrame, needle: str, limit: int = 32) -> DataFrame:
    return bank.filter(F.contains(text.normalize(F.col("core_text")), text.normalize(F.lit(needle)))).orderBy("id").limit(limit)


def missing_references(records: DataFrame, sessions: DataFrame, projections: DataFrame) -> DataFrame:
    """Records of a session's workspace without a projection there; all by equi-joins."""
    pairs = records.select("workspace_id", "record_id").join(sessions.select("workspace_id", "session_id"), "workspace_id")
    return pairs.join(projections.select("record_id", "session_id"), ["record_id", "session_id"], "left_anti").withColumn("state", F.lit("reference"))


def stale_references(records: DataFrame, projections: DataFrame) -> DataFrame:
    return projections.join(records.select("record_id"), "record_id", "left_anti")


def status_labels(projections: DataFrame, records: DataFrame) -> DataFrame:
    return projections.join(records.select("record_id", "label"), "record_id", "left").withColumn("label", F.coalesce("label", "record_id"))


def set_projection(projections: DataFrame, changes: DataFrame) -> DataFrame:
    """``record_id, session_id, state, at``: the latest state of each wins."""
    rows = projections.unionByName(changes)
    return rows.groupBy("record_id", "session_id").agg(F.max_by("state", F.struct("at", "state")).alias("state"), F.max("at").alias("at"))


def expired(projections: DataFrame, records: DataFrame, decision: Column) -> DataFrame:
    """New states of full projections whose record expires: inactive in the source session, elsewhere a reference."""
    rows = projections.filter("state = 'full-projection'").join(records, "record_id").filter(decision)
    return rows.select("record_id", "session_id", F.when(F.col("session_id") == F.col("source_session_id"), "inactive").otherwise("reference").alias("state"))


def forget(bank: DataFrame, semi: DataFrame, sensory: DataFrame, needle: str) -> dict[str, DataFrame]:
    """What a request to forget removes: bank records by id or contained text, and what was made from them."""
    hit = (F.col("id") == needle) | F.contains(text.normalize(F.col("core_text")), text.normalize(F.lit(needle)))
    gone = bank.filter(hit & F.col("tombstoned_at").isNull())
    semis = semi.join(gone.select(F.col("id").alias("bank_record_id")), "bank_record_id", "left_semi")
    chunks = sensory.join(semis.select(F.col("id").alias("segment_id")), "segment_id", "left_semi")
    return {"bank": gone, "semi": semis, "sensory": chunks}


def counts(rows: DataFrame, by: str) -> DataFrame:
    """Rows by value, null as ``unknown``."""
    return rows.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))


def layer_counts(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Of each scope: parents, those current, by state of their vectors, and their children. ``rows`` has one row a parent."""
    return rows.groupBy(*scope).agg(
        F.count("*").alias("parents"), F.count_if(F.coalesce("current", F.lit(True))).alias("current"), F.count_if(F.col("vector_state") == "active").alias("active"),
        F.count_if(F.col("vector_state") == "pending-vector").alias("pending"), F.coalesce(F.sum("n_children"), F.lit(0)).alias("children"),
    )


def is_update(core: Column) -> Column:
    t = F.trim(text.nonblank(core))
    return t.rlike(text.UPDATE) & (F.length(t) <= 1024) & ~t.rlike(r"(?m)^---\s+.+\s+---$")


def superseded(children: DataFrame) -> DataFrame:
    """Children that a later explicit update of the same session replaces: ``old_child_id, new_child_id, new_parent_id``.

    ``children`` has ``session_id, position`` (order of storing), ``parent_id, child_id, core_text`` (the parent's),
    ``text, vector, vector_model``. An old child is replaced by the earliest later update with other text that shares two
    strong tokens and is similar: cosine of at least 0.45, or without vectors three shared tokens. Tokens meet by an
    equi-join on session and token, so no pair without two tokens in common is made.
    """
    rows = children.withColumn("tokens", F.filter(text.lexical_tokens(F.col("text")), lambda t: (t.rlike(f"^{text.CJK}$") & (F.length(t) >= 2)) | ((F.length(t) >= 3) & ~t.rlike(r"^\d+$"))))
    facts = rows.select("session_id", "position", "parent_id", "child_id", "text", "vector", "vector_model")
    spread = rows.select("session_id", "position", "parent_id", "child_id", F.col("core_text"), F.explode("tokens").alias("token"))
    new = spread.filter(is_update(F.col("core_text"))).select("session_id", "token", F.col("position").alias("np"), F.col("child_id").alias("new_child_id"), F.col("parent_id").alias("new_parent_id"))
    old = spread.select("session_id", "token", F.col("position").alias("op"), F.col("child_id").alias("old_child_id"), F.col("parent_id").alias("old_parent_id"))
    pairs = new.join(old, ["session_id", "token"]).filter("op < np and old_parent_id <> new_parent_id")
    pairs = pairs.groupBy("session_id", "new_child_id", "new_parent_id", "old_child_id", "np", "op").agg(F.count("*").alias("shared")).filter("shared >= 2")
    side = lambda p: facts.select(F.col("session_id"), F.col("child_id").alias(f"{p}_child_id"), F.col("text").alias(f"{p}t"), F.col("vector").alias(f"{p}v"), F.col("vector_model").alias(f"{p}m"))
    pairs = pairs.join(side("new"), ["session_id", "new_child_id"]).join(side("old"), ["session_id", "old_child_id"])
    similar = F.when(F.col("newv").isNotNull() & F.col("oldv").isNotNull(), vector.cosine(F.col("newv"), F.col("oldv"))).otherwise(F.when(F.col("shared") >= 3, 1.0).otherwise(0.0))
    pairs = pairs.filter("newt <> oldt").filter(similar >= 0.45)
    first = F.min_by(F.struct("new_child_id", "new_parent_id"), F.struct("np", "new_child_id"))
    return pairs.groupBy("session_id", "old_child_id").agg(first.alias("n")).select("session_id", "old_child_id", "n.*")


def current_view(core: Column, ranges: Column) -> Column:
    """The text without its superseded ranges (array of struct ``start_offset, end_offset``); as it is without any.

    Ranges are clipped and merged; what remains is joined by lines, and three or more line ends become two.
    """
    n = F.length(core)
    valid = F.filter(F.transform(ranges, lambda r: F.struct(F.greatest(F.lit(0), r["start_offset"]).alias("a"), F.least(n, r["end_offset"]).alias("b"))), lambda r: r["a"] < r["b"])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    step = lambda acc, r: F.struct(F.greatest(acc["at"], r["b"]).alias("at"), F.when(r["a"] > acc["at"], F.concat(acc["parts"], F.array(F.substring(core, acc["at"] + 1, r["a"] - acc["at"])))).otherwise(acc["parts"]).alias("parts"))
    whole = lambda acc: F.array_join(F.concat(acc["parts"], F.when(acc["at"] < n, F.array(F.substring(core, acc["at"] + 1, n))).otherwise(F.array().cast("array<string>"))), "\n")
    left = F.aggregate(F.array_sort(valid), start, step, whole)
    return F.when(F.size(valid) > 0, F.regexp_replace(F.regexp_replace(left, "\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")).otherwise(core)


def superseded_ranges(links: DataFrame, children: DataFrame) -> DataFrame:
    """Of each parent the ranges of its replaced children, and whether any child is still current."""
    rows = children.join(links.select(F.col("old_child_id").alias("child_id"), "new_child_id"), "child_id", "left")
    hit = F.when(F.col("new_child_id").isNotNull(), F.struct("start_offset", "end_offset", F.col("child_id").alias("old_child_id"), "new_child_id"))
    return rows.groupBy("parent_id").agg(F.array_sort(F.collect_list(hit)).alias("ranges"), F.bool_or(F.col("new_child_id").isNull()).alias("current"))


def compacted(segments: DataFrame, ranges: DataFrame, size: int = 64) -> DataFrame:
    """The first range (by ``range_no``) that overlaps each segment of its session: ``session_id, segment_id, range_no``.

    Both meet by buckets of ``size`` numbers, so a session's segments aren't compared with all of its ranges.
    """
    spread = lambda df, low, high: df.withColumn("b", F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))))
    left = spread(segments.select("session_id", "segment_id", "first_seq", "last_seq").filter("first_seq <= last_seq"), "first_seq", "last_seq")
    right = spread(ranges.select("session_id", "range_no", "start", "end").filter("start <= end"), "start", "end")
    rows = left.join(right, ["session_id", "b"]).filter("first_seq <= end and last_seq >= start")
    return rows.groupBy("session_id", "segment_id").agg(F.min("range_no").alias("range_no"))


def latest_captures(requests: DataFrame) -> DataFrame:
    """The newest request of each session and kind."""
    n = F.row_number().over(Window.partitionBy("session_id", "kind").orderBy(F.desc("sequence")))
    return requests.withColumn("n", n).filter("n = 1").drop("n")


def within_budget_of_calls(calls: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` calls of each session, turn and tool."""
    n = F.row_number().over(Window.partitionBy("session_id", "turn", "tool_name").orderBy("seq"))
    return calls.withColumn("n", n).filter(F.col("n") <= limit).drop("n")
