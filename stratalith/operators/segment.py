"""Event logs: messages, turn segments, source references, visible surface, tool pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.functions import text

#: Kinds and roles (fixed values).
ROLE_OF = {"user/message": "user", "assistant/message": "assistant", "tool/result": "tool"}
PROJECTION_PURPOSES = ("sensory-checkpoint", "sensory-root-manifest", "semipersistent-snapshot", "semipersistent-pointer", "semipersistent-superseded")
CATALOG_PURPOSES = ("sensory-catalog", "sensory-catalog-legacy", *PROJECTION_PURPOSES)
CHUNK = 4096
BLOCKS = "array<struct<type string, text string, content string>>"


def block_text(content: Column, types: tuple[str, ...] | None = None, sep: str = "\n") -> Column:
    """Plain content as it is; of a JSON array the texts of its blocks (of the given types)."""
    parsed = F.from_json(content, BLOCKS)
    wanted = parsed if types is None else F.filter(parsed, lambda b: b["type"].isin(*types))
    texts = F.filter(F.transform(wanted, lambda b: F.coalesce(b["text"], b["content"])), lambda t: t.isNotNull())
    return F.when(F.startswith(F.ltrim(content), F.lit("[")) & parsed.isNotNull(), F.array_join(texts, sep)).otherwise(text.nonblank(content))


def records(events: DataFrame) -> DataFrame:
    """Messages as flat records; other kinds of event are dropped, repeated rows count once (the first ingested)."""
    role = F.create_map(*(F.lit(x) for pair in ROLE_OF.items() for x in pair))[F.col("event_type")]
    rows = events.withColumn("role", role).filter("role is not null and session_id is not null and seq is not null")
    rest = ["turn", "role", "event_time", "call_id", "tool_name", "content", "source_kind", "purpose", "workspace_id", "block_kinds"]
    rows = rows.withColumn("source_kind", F.col("source.kind")).withColumn("purpose", F.col("source.purpose"))
    first = F.min_by(F.struct(*rest), F.struct(F.col("ingested_at").isNull().alias("n"), "ingested_at", F.xxhash64(*rest).alias("h")))
    rows = rows.groupBy("session_id", "seq").agg(first.alias("r")).select("session_id", "seq", "r.*")
    return rows.withColumn("text", block_text(F.col("content"))).drop("content")


def is_projection(kind: Column, purpose: Column) -> Column:
    return F.coalesce((kind == "plugin") & purpose.isin(*PROJECTION_PURPOSES), F.lit(False))


def turn_windows(events: DataFrame) -> DataFrame:
    """``session_id, turn, start_seq, end_seq``: of each turn the latest ``turn/start`` up to the next start of any turn."""
    starts = events.filter("event_type = 'turn/start' and turn is not null").select("session_id", "turn", "seq").distinct()
    after = F.lead("seq").over(Window.partitionBy("session_id").orderBy("seq"))
    starts = starts.withColumn("next", after)
    return starts.groupBy("session_id", "turn").agg(F.max("seq").alias("start_seq"), F.max_by("next", "seq").alias("next")).select("session_id", "turn", "start_seq", (F.col("next") - 1).alias("end_seq"))


def last_mark(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows with ``mark``: the greatest ``seq`` of their session's marks that isn't beyond their own; null before the first.

    One ordered pass over chunks of ``CHUNK`` numbers; a chunk gets the last mark before it from one small row per chunk. So
    rows never meet all marks of a session, and no session is gathered in one task.
    """
    tagged = rows.withColumn("__mark", F.lit(None).cast("bigint")).unionByName(marks.select("session_id", "seq").distinct().withColumn("__mark", F.col("seq").cast("bigint")), allowMissingColumns=True)
    tagged = tagged.withColumn("__chunk", F.floor(F.col("seq") / CHUNK))
    chunks = tagged.groupBy("session_id", "__chunk").agg(F.max("__mark").alias("most"))
    before = F.max("most").over(Window.partitionBy("session_id").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))
    chunks = chunks.select("session_id", "__chunk", before.alias("__before"))
    here = F.max("__mark").over(Window.partitionBy("session_id", "__chunk").orderBy("seq", F.col("__mark").isNull()))
    out = tagged.withColumn("__here", here).filter("__mark is null").join(chunks, ["session_id", "__chunk"])
    return out.withColumn("mark", F.coalesce("__here", "__before")).drop("__mark", "__chunk", "__here", "__before")


def in_windows(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Records with the ``turn`` of the window they lie in; those outside are left out."""
    starts = events.filter("event_type = 'turn/start' and turn is not null and session_id is not null and seq is not null")
    windows = turn_windows(events).withColumnRenamed("start_seq", "mark")
    return last_mark(rows.drop("turn"), starts).join(windows, ["session_id", "mark"]).filter("end_seq is null or seq <= end_seq").drop("mark", "end_seq")


def segments(events: DataFrame) -> DataFrame:
    """One row per turn: its records' range and count, messages by role and tokens. Projections are no records."""
    inside = in_windows(records(events).filter(~is_projection(F.col("source_kind"), F.col("purpose"))), events)
    return inside.groupBy("session_id", "turn").agg(
        F.concat(F.lit("seg-"), F.first("session_id"), F.lit("-"), F.first("turn").cast("string")).alias("segment_id"),
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n_records"),
        F.count_if(F.col("role") == "user").alias("n_user"), F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.count_if(F.col("role") == "tool").alias("n_tool"),
        F.sum(text.estimate_tokens(F.col("text"))).alias("tokens"), F.max("event_time").alias("last_time"),
    )


def source_refs(events: DataFrame) -> DataFrame:
    """``session_id, segment_id, seq, canonical``; canonical are the user's own messages and tool results."""
    rows = in_windows(records(events), events)
    canonical = ((F.col("role") == "user") & (F.coalesce("source_kind", F.lit("user")) == "user")) | (F.col("role") == "tool")
    return rows.select("session_id", F.concat_ws("-", F.lit("seg"), "session_id", "turn").alias("segment_id"), "seq", canonical.alias("canonical"))


def source_text(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The records of each group by lines ``[seq n] role: text``, projections left out. A group is one turn."""
    speaker = F.when(F.col("role") == "tool", F.concat(F.lit("tool:"), F.coalesce("tool_name", F.lit("result")))).otherwise(F.col("role"))
    line = F.format_string("[seq %d] %s: %s", F.col("seq"), speaker, F.col("text"))
    rows = rows.filter(~is_projection(F.col("source_kind"), F.col("purpose"))).withColumn("line", line)
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("source_text"))


def visible(events: DataFrame, replaces: DataFrame) -> DataFrame:
    """Events that no later replacement covers. ``replaces`` has ``session_id, seq, start, end``; an interval anti-join.

    Ranges meet events by buckets of sequence numbers, so that a long session isn't compared with all of its ranges.
    """
    size = 64
    ranges = replaces.select("session_id", F.col("seq").alias("r"), "start", "end", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(F.col("end") / size))).alias("b"))
    rows = events.withColumn("b", F.floor(F.col("seq") / size))
    hidden = (F.col("e.session_id") == F.col("r.session_id")) & (F.col("e.b") == F.col("r.b")) & F.col("e.seq").between(F.col("r.start"), F.col("r.end")) & (F.col("e.seq") < F.col("r.r"))
    return rows.alias("e").join(ranges.alias("r"), hidden, "left_anti").drop("b")


def unpaired_calls(events: DataFrame) -> DataFrame:
    """``session_id, call_id, side``: calls without a result and results without a call."""
    rows = events.filter("call_id is not null and session_id is not null").select("session_id", "call_id", "event_type").distinct()
    calls = rows.filter("event_type = 'assistant/message'").drop("event_type")
    results = rows.filter("event_type = 'tool/result'").drop("event_type")
    keys = ["session_id", "call_id"]
    return calls.join(results, keys, "left_anti").withColumn("side", F.lit("call")).unionByName(results.join(calls, keys, "left_anti").withColumn("side", F.lit("result")))


def protected_boundary(rows: DataFrame, at: str = "boundary") -> DataFrame:
    """An insertion point moved down, so that it never parts a call from its results. ``rows`` has one boundary a session."""
    spans = rows.filter("call_id is not null").groupBy("session_id", "call_id").agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.first(at).alias(at))
    cut = spans.filter(f"low < {at} and high >= {at}").groupBy("session_id").agg(F.min("low").alias("low"))
    return rows.select("session_id", at).distinct().join(cut, "session_id", "left").select("session_id", F.coalesce("low", at).alias(at))
