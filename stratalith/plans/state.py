"""Queries over the event log, the ledger and the layers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalith import storage
from stratalith.api import ledger_counts
from stratalith.config import Config
from stratalith.functions import policy, text
from stratalith.operators import cdc, layers, segment, surface
from stratalith.plans import tables as t
from stratalith.plans.cdc import P1_SQL
from stratalith.sources.ledger import tombstoned
from stratalith.streaming import turns

#: The time at which decisions are made; the log ends before it (a parameter of these queries).
NOW = "2024-02-01 00:00:00"
TURN_NOW = 32


def _events(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "session_events")


def _state(spark: SparkSession, d: str) -> DataFrame:
    return cdc.rebuild_ledger(t.table(spark, d, "ledger_snapshot"), t.table(spark, d, "ledger_journal"))


# the event log


def turn_segments(spark: SparkSession, d: str) -> DataFrame:
    return segment.segments(_events(spark, d)).select("session_id", "turn", "segment_id", "first_seq", "last_seq", "n_records", "n_user", "n_assistant", "n_tool")


def segment_source_refs(spark: SparkSession, d: str) -> DataFrame:
    return segment.source_refs(_events(spark, d))


def segment_tokens(spark: SparkSession, d: str) -> DataFrame:
    return segment.segments(_events(spark, d)).select("session_id", "turn", "tokens")


def segment_source_text(spark: SparkSession, d: str) -> DataFrame:
    return segment.source_text(segment.records(_events(spark, d)), ["session_id", "turn"])


def _replaced(spark: SparkSession, d: str) -> DataFrame:
    """Windows of turns that were started again: the later start replaces the earlier window."""
    starts = _events(spark, d).filter("event_type = 'turn/start' and turn is not null and session_id is not null").select("session_id", "turn", "seq").distinct()
    rows = starts.withColumn("next", F.lead("seq").over(Window.partitionBy("session_id").orderBy("seq"))).withColumn("again", F.lead("seq").over(Window.partitionBy("session_id", "turn").orderBy("seq")))
    return rows.filter("again is not null").select("session_id", F.col("again").alias("seq"), F.col("seq").alias("start"), (F.col("next") - 1).alias("end"))


REPLACED_SQL = """replaced AS (SELECT session_id, again AS r, seq AS start_seq, nxt - 1 AS end_seq FROM (
  SELECT session_id, seq, lead(seq) OVER (PARTITION BY session_id ORDER BY seq) AS nxt, lead(seq) OVER (PARTITION BY session_id, turn ORDER BY seq) AS again
  FROM (SELECT DISTINCT session_id, turn, seq FROM session_events WHERE event_type = 'turn/start' AND turn IS NOT NULL AND session_id IS NOT NULL)) WHERE again IS NOT NULL)"""


def surface_visible(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("session_id", "seq").distinct()
    return segment.visible(rows, _replaced(spark, d))


def compaction_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Ranges that reach two rows into the window after a replaced one."""
    ranges = _replaced(spark, d).withColumn("end", F.col("end") + 2).withColumn("range_no", F.row_number().over(Window.partitionBy("session_id").orderBy("start", "seq")).cast("bigint"))
    return layers.compacted(segment.segments(_events(spark, d)), ranges.drop("seq"))


def tool_pair_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return segment.unpaired_calls(_events(spark, d))


def call_budget(spark: SparkSession, d: str) -> DataFrame:
    calls = _events(spark, d).filter("event_type = 'tool/result' and tool_name is not null and session_id is not null").select("session_id", "turn", "tool_name", "seq").distinct()
    return layers.within_budget_of_calls(calls, 1)


def eviction_order(spark: SparkSession, d: str) -> DataFrame:
    """Pressure on small windows of 600 tokens, so that sessions are evicted."""
    rows = segment.segments(_events(spark, d)).withColumn("now", F.max("turn").over(Window.partitionBy("session_id")))
    out = surface.eviction(rows, F.lit(600), F.col("now"), Config(), checkpoint_tokens=20)
    return out.select("session_id", "turn", "tokens", F.col("rank").cast("bigint").alias("rank"), "evicted")


def manifest_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = segment.segments(_events(spark, d)).withColumn("label", F.col("segment_id"))
    return surface.manifest(rows).select("session_id", F.col("level").cast("bigint").alias("level"), "node", "first_seq", "last_seq")


def request_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Over the text as stored, without reading blocks."""
    rows = _events(spark, d).filter("content is not null and session_id is not null")
    return surface.request_attributes(rows.select("session_id", "role", F.col("source.kind").alias("source_kind"), F.col("content").alias("text")))


def latest_capture(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).filter("event_type is not null and session_id is not null and seq is not null").select("session_id", F.col("event_type").alias("kind"), F.col("seq").alias("sequence")).distinct()
    return layers.latest_captures(rows)


def _segment_costs(spark: SparkSession, d: str) -> DataFrame:
    return segment.segments(_events(spark, d)).select("session_id", "turn", "first_seq", "tokens")


def budget_skip(spark: SparkSession, d: str) -> DataFrame:
    return surface.skipping(_segment_costs(spark, d), ["session_id"], ["first_seq", "turn"], F.col("tokens") + 24, F.lit(300)).select("session_id", "turn", "accepted")


def budget_break(spark: SparkSession, d: str) -> DataFrame:
    return surface.stopping(_segment_costs(spark, d), ["session_id"], [F.col("first_seq"), F.col("turn")], F.col("tokens"), F.lit(300)).select("session_id", "turn", "accepted")


def pressure_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = _segment_costs(spark, d).groupBy("session_id").agg(F.sum("tokens").alias("tokens"))
    b = surface.budget(F.col("tokens"), F.lit(2000), F.lit(1000), F.lit(None).cast("bigint"))
    return rows.select("session_id", "tokens", b.alias("b")).select("session_id", "tokens", F.round("b.pressure", 6).alias("pressure"), F.col("b.triggered").alias("triggered"), F.col("b.target").alias("target"))


PROJECTION_SQL = "coalesce(source_kind = 'plugin' AND purpose IN ('sensory-checkpoint', 'sensory-root-manifest', 'semipersistent-snapshot', 'semipersistent-pointer', 'semipersistent-superseded'), false)"
RECORDS_SQL = t.SQL_RECORDS + """,
starts AS (SELECT *, lead(seq) OVER (PARTITION BY session_id ORDER BY seq) AS nxt FROM (SELECT DISTINCT session_id, turn, seq FROM session_events WHERE event_type = 'turn/start' AND turn IS NOT NULL)),
win AS (SELECT session_id, turn, max(seq) AS start_seq, arg_max(nxt, seq) - 1 AS end_seq FROM (SELECT * FROM starts) GROUP BY ALL),
win2 AS (SELECT w.session_id, w.turn, w.start_seq, s.nxt - 1 AS end_seq FROM win w JOIN starts s ON s.session_id = w.session_id AND s.seq = w.start_seq AND s.turn = w.turn),
inside AS (SELECT r.*, w.turn FROM rec r JOIN win2 w ON r.session_id = w.session_id AND r.seq >= w.start_seq AND (w.end_seq IS NULL OR r.seq <= w.end_seq)),
seg AS (SELECT session_id, turn, 'seg-' || session_id || '-' || turn AS segment_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_records,
    count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, count(*) FILTER (role = 'tool') AS n_tool
  FROM inside WHERE NOT """ + PROJECTION_SQL + " GROUP BY ALL)"
#: Segments with their tokens.
COSTS_SQL = f"""{RECORDS_SQL}, costs AS (SELECT session_id, turn, min(seq) AS first_seq, CAST(sum({t.sql_estimate("text")}) AS BIGINT) AS tokens FROM inside WHERE NOT {PROJECTION_SQL} GROUP BY ALL)"""


# the ledger


def ledger_replay(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d).select("scope_kind", "scope_id", "collection", "id", "value_json")


def ledger_scope_counts(spark: SparkSession, d: str) -> DataFrame:
    return ledger_counts(_state(spark, d))


def ledger_scan(spark: SparkSession, d: str) -> DataFrame:
    """Live records of the sensory collection that aren't soft-deleted."""
    rows = _state(spark, d).filter("collection = 'sensoryChunks'")
    return rows.filter(~F.coalesce(tombstoned(F.col("value_json")), F.lit(False))).select("scope_kind", "scope_id", "id")


VALUE_SQL = P1_SQL.replace("mutation_seq, logged_at,", "mutation_seq, logged_at, value_json,", 1).replace("mutation_seq, NULL, false", "mutation_seq, NULL, value_json, false", 1)
LIVE_SQL = VALUE_SQL.replace("SELECT scope_kind, scope_id, collection, id, mutation_seq FROM ranked WHERE n = 1 AND NOT gone", "")


def _projections(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records that aren't soft-deleted, sessions, and projections with ``live``: soft-deleted ones exist but aren't deleted again."""
    rows = _state(spark, d).withColumn("live", ~F.coalesce(tombstoned(F.col("value_json")), F.lit(False)))
    records = rows.filter("collection = 'semipersistentRecords' and scope_kind = 'workspace' and live").select(F.col("scope_id").alias("workspace_id"), F.col("id").alias("record_id"))
    made = rows.filter("collection = 'semipersistentProjections'").select(F.split_part("id", F.lit("@"), F.lit(1)).alias("record_id"), F.split_part("id", F.lit("@"), F.lit(2)).alias("session_id"), "live")
    sessions = _events(spark, d).filter("workspace_id is not null and session_id is not null").select("workspace_id", "session_id").distinct()
    return records, sessions, made


def reference_sync(spark: SparkSession, d: str) -> DataFrame:
    records, sessions, made = _projections(spark, d)
    new = layers.missing_references(records, sessions, made).select("record_id", "session_id", F.lit("create").alias("action"))
    return new.unionByName(layers.stale_references(records, made.filter("live")).select("record_id", "session_id", F.lit("delete").alias("action")))


# associations


def _uses(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "events")
    return rows.select(
        F.concat(F.lit("item-"), F.get_json_object("props", "$.k")).alias("item_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
        F.dayofmonth("ts").cast("bigint").alias("turn"), F.col("ts").alias("at"), F.col("value").alias("weight"), (F.col("event_type") != "error").alias("verified"), "event_id",
    )


USES_SQL = """WITH u AS (SELECT 'item-' || (props->>'$.k') AS item_id, 'u' || user_id AS session_id, CAST(day(ts) AS BIGINT) AS turn, ts AS used_at, value AS weight, event_type <> 'error' AS verified, event_id FROM events),
uses AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY item_id, session_id, turn ORDER BY used_at) = 1)"""
FACTS_SQL = (
    USES_SQL
    + f""", facts AS (SELECT item_id, ln(sum(greatest(weight, 0) * pow(1 + greatest({TURN_NOW} - turn, 0), -0.5) * pow(2.0, -greatest(epoch_us(TIMESTAMP '{NOW}') - epoch_us(used_at), 0) / 3.6e9 / 24))) AS activation,
  count(*) FILTER (verified AND weight > 0 AND {TURN_NOW} - turn <= 8) AS strong_recent, count(*) FILTER (verified AND weight > 0) AS strong, count(DISTINCT session_id) FILTER (verified AND weight > 0) AS sessions,
  max(turn) AS last_turn, max(used_at) AS last_at FROM uses GROUP BY item_id)"""
)


def association_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return policy.distinct_uses(_uses(spark, d).drop("event_id")).select("item_id", "session_id", "turn", F.col("at").alias("used_at"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return policy.use_facts(policy.distinct_uses(_uses(spark, d).drop("event_id")), F.lit(NOW).cast("timestamp_ntz"), F.lit(TURN_NOW))


def activation(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).select("item_id", F.round("activation", 6).alias("activation"), "strong_recent", "strong", "sessions", "last_turn")


def layer_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Promotion and expiry of items, with quality and durability of 0.9 and importance of 0.5."""
    rows, good, low = _facts(spark, d), F.lit(0.9), F.lit(0.5)
    idle = F.lit(TURN_NOW) - F.col("last_turn")
    hours = policy.hours(F.lit(NOW).cast("timestamp_ntz"), F.col("last_at"))
    return rows.select(
        "item_id", policy.to_semi(F.lit(True), good, good, low, F.col("strong_recent")).alias("to_semi"),
        policy.to_bank(F.lit(True), F.lit("decision"), F.col("strong"), F.col("sessions"), low, good, F.lit(False)).alias("to_bank"),
        policy.expires(F.lit(False), F.lit(False), idle, hours, F.col("activation")).alias("expires"),
    )


# layers


def supersede(spark: SparkSession, d: str) -> DataFrame:
    """Texts are the children's slices of ``core_text``; a child without offsets has none and takes no part."""
    owner = t.parents(spark, d).filter("session_id is not null")
    position = F.row_number().over(Window.partitionBy("session_id").orderBy("updated_at", "parent_no"))
    updated = F.bool_or(layers.is_update(F.col("core_text"))).over(Window.partitionBy("session_id"))
    owner = owner.select("session_id", "parent_id", "core_text", position.alias("position"), updated.alias("updated")).filter("updated").drop("updated")  # no links without an update
    start = F.greatest(F.lit(0), F.col("start_offset"))
    rows = t.children(spark, d).join(owner, "parent_id").withColumn("text", F.substring("core_text", start + 1, F.col("end_offset") - start)).filter("start_offset is not null and text <> ''")
    rows = rows.select("session_id", "position", "parent_id", "child_id", "core_text", "text", "vector", "vector_model")
    return layers.superseded(rows).select("session_id", "old_child_id", "new_child_id")


def current_views(spark: SparkSession, d: str) -> DataFrame:
    """Parents with superseded children, and the text that is left."""
    links = storage.materialize(supersede(spark, d), "links")
    kids = t.children(spark, d).filter("start_offset is not null and end_offset is not null").select("parent_id", "child_id", "start_offset", "end_offset")
    ranges = layers.superseded_ranges(links, kids).filter(F.size("ranges") > 0)
    rows = ranges.join(t.parents(spark, d).select("parent_id", "core_text"), "parent_id")
    return rows.select("parent_id", "current", F.length(layers.current_view(F.col("core_text"), F.col("ranges"))).alias("n_chars"))


def layer_counts(spark: SparkSession, d: str) -> DataFrame:
    kids = t.children(spark, d).groupBy("parent_id").agg(F.count("*").alias("n_children"), F.max("vector_state").alias("vector_state"))
    rows = t.parents(spark, d).join(kids, "parent_id", "left").withColumn("current", F.col("temporal_current"))
    return layers.layer_counts(rows, ["workspace_id"])


def count_by(spark: SparkSession, d: str) -> DataFrame:
    return layers.counts(t.table(spark, d, "documents"), "court_name")


def cube_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "documents").cube("lang", "source").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))
    return rows


def distinct_layers(spark: SparkSession, d: str) -> DataFrame:
    """The four collections together, one row per layer, scope and id: the last."""
    rows = _state(spark, d).filter(F.col("collection").isin("sensoryChunks", "sourceSegments", "bankChunks", "semipersistentRecords"))
    return rows.groupBy("collection", "scope_id", "id").agg(F.max("mutation_seq").alias("mutation_seq"))


def bank_visible(spark: SparkSession, d: str) -> DataFrame:
    """What workspace ``ws-hub`` sees of the bank: its own records and the user's. One without the field counts as verified."""
    rows = _state(spark, d).filter("collection = 'bankChunks'")
    got = lambda name: F.get_json_object("value_json", f"$.{name}")
    bank = rows.select("scope_kind", "scope_id", "id", F.coalesce(got("verifiedSource") == "true", F.lit(True)).alias("verified"), (got("temporalCurrent") == "true").alias("current"), got("supersededBy").alias("superseded_by"), got("tombstonedAt").alias("tombstoned_at"))
    return layers.bank_visible(bank, "ws-hub").select("scope_kind", "scope_id", "id")


def remember_requests(spark: SparkSession, d: str) -> DataFrame:
    rows = segment.records(_events(spark, d)).filter("role = 'user'")
    return rows.select("session_id", "seq", text.remember(F.col("text")).alias("r"), text.should_review(F.col("text"), F.lit(True), F.lit(True)).alias("review")).select("session_id", "seq", "r.content", "r.scope_kind", "review")


# streams


def _run(df: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now, into a table of the shared folder."""
    spark, schema = df.sparkSession, df.schema
    out = storage.new_path(spark, name)
    df.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/rows")


def _source(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.readStream.schema(t.table(spark, d, name).schema).parquet(f"{d}/{name}.parquet*")


def stream_turns(spark: SparkSession, d: str) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", turns.ROCKSDB)
    return _run(turns.turns(_source(spark, d, "session_events"), 600, 400), "turns")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = _run(turns.windowed_counts(_source(spark, d, "events")), "windows")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


def stream_ttl(spark: SparkSession, d: str) -> DataFrame:
    """Sessions without an event for a day, as the stream of events closes them."""
    rows = _run(turns.idle_sessions(_source(spark, d, "session_events").select("session_id", "event_time")), "idle")
    return rows.select("session_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def stream_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The journal as a stream, applied batch by batch to the snapshot's table."""
    where = storage.new_path(spark, "stream-ledger")
    table = cdc.BucketedTable.create(cdc.ledger_base(t.table(spark, d, "ledger_snapshot")), f"{where}/table", cdc.LEDGER)
    turns.apply_feed(_source(spark, d, "ledger_journal"), table, f"{where}/state").awaitTermination()
    return table.rows().select(*cdc.LEDGER.keys, F.col(cdc.SEQ).alias("mutation_seq"))


QUERIES = {
    f.__name__: f
    for f in (
        turn_segments, segment_source_refs, segment_tokens, segment_source_text, surface_visible, compaction_overlap, tool_pair_antijoin, call_budget, eviction_order, manifest_groups,
        request_attributes, latest_capture, budget_skip, budget_break, pressure_budget, ledger_replay, ledger_scope_counts, ledger_scan, reference_sync, association_dedupe, activation,
        layer_decisions, supersede, current_views, layer_counts, count_by, cube_counts, distinct_layers, bank_visible, remember_requests, stream_turns, stream_windows, stream_ttl, stream_ledger,
    )
}

SQL = {
    "turn_segments": f"WITH {RECORDS_SQL} SELECT * FROM seg",
    "segment_tokens": f"WITH {COSTS_SQL} SELECT session_id, turn, tokens FROM costs",
    "segment_source_refs": f"WITH {RECORDS_SQL} SELECT session_id, 'seg-' || session_id || '-' || turn AS segment_id, seq, (role = 'user' AND coalesce(source_kind, 'user') = 'user') OR role = 'tool' AS canonical FROM inside",
    "segment_source_text": f"""WITH {RECORDS_SQL}, own AS (SELECT session_id, seq, min(turn) AS turn FROM (SELECT session_id, seq, turn, row_number() OVER (PARTITION BY session_id, seq ORDER BY ingested_at NULLS LAST) AS n FROM session_events
    WHERE event_type IN ('user/message', 'assistant/message', 'tool/result')) WHERE n = 1 GROUP BY ALL)
SELECT session_id, turn, string_agg('[seq ' || seq || '] ' || CASE WHEN role = 'tool' THEN 'tool:' || coalesce(tool_name, 'result') ELSE role END || ': ' || text, chr(10) ORDER BY seq) AS source_text
FROM rec JOIN own USING (session_id, seq) WHERE NOT {PROJECTION_SQL} GROUP BY ALL""",
    "eviction_order": f"""WITH {COSTS_SQL}, aged AS (SELECT *, max(turn) OVER (PARTITION BY session_id) - turn AS inactive, sum(tokens) OVER (PARTITION BY session_id) AS total FROM costs),
placed AS (SELECT *, row_number() OVER w AS rank, total - coalesce(sum(greatest(0, tokens - 20)) OVER (PARTITION BY session_id ORDER BY inactive >= 4 DESC, inactive DESC, tokens DESC, first_seq, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM aged WINDOW w AS (PARTITION BY session_id ORDER BY inactive >= 4 DESC, inactive DESC, tokens DESC, first_seq, turn))
SELECT session_id, turn, tokens, rank, total / 600 >= 0.65 AND before > 330 AS evicted FROM placed""",
    "budget_break": f"""WITH {COSTS_SQL}, summed AS (SELECT *, sum(tokens) OVER w > 300 AND row_number() OVER w > 1 AS stops FROM costs WINDOW w AS (PARTITION BY session_id ORDER BY first_seq, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT session_id, turn, NOT bool_or(stops) OVER (PARTITION BY session_id ORDER BY first_seq, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS accepted FROM summed""",
    "budget_skip": f"""WITH RECURSIVE {COSTS_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first_seq, turn) AS n FROM costs),
walk AS (SELECT session_id, turn, n, CASE WHEN tokens + 24 <= 300 THEN tokens + 24 ELSE 0 END AS used, tokens + 24 <= 300 AS accepted FROM placed WHERE n = 1
  UNION ALL SELECT p.session_id, p.turn, p.n, CASE WHEN w.used + p.tokens + 24 <= 300 THEN w.used + p.tokens + 24 ELSE w.used END, w.used + p.tokens + 24 <= 300 FROM walk w JOIN placed p ON p.session_id = w.session_id AND p.n = w.n + 1)
SELECT session_id, turn, accepted FROM walk""",
    "pressure_budget": f"WITH {COSTS_SQL} SELECT session_id, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens) / 1000, 6) AS pressure, sum(tokens) / 1000 >= 0.65 AS triggered, CAST(550 AS BIGINT) AS target FROM costs GROUP BY session_id",
    "remember_requests": f"""WITH {RECORDS_SQL}, said AS (SELECT session_id, seq, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS b FROM rec WHERE role = 'user'),
got AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(b, '{text.REMEMBER.replace("(?isU)", "(?is)")}', 1), '^\\s+|\\s+$', '', 'g'), '(?i)^(?:(?:全局|跨工作区|所有项目|所有工作区|global|cross[- ]workspace)\\s*)+[：:,，]\\s*', '') AS c FROM said),
judged AS (SELECT *, regexp_matches(b, '{text.REMEMBER.replace("(?isU)", "(?is)")}') AND NOT regexp_matches(b, '{text.NEGATED}') AND NOT regexp_matches(b, '{text.QUOTED}') AND length(c) >= 2 AS valid FROM got)
SELECT session_id, seq, CASE WHEN valid THEN c END AS content, CASE WHEN valid THEN CASE WHEN regexp_matches(b, '{text.EVERYWHERE}') THEN 'user-global' ELSE 'workspace' END END AS scope_kind, regexp_matches(text, '{text.REVIEW}') AS review FROM judged""",
    "surface_visible": f"WITH {REPLACED_SQL} SELECT DISTINCT session_id, seq FROM session_events e WHERE NOT EXISTS (SELECT 1 FROM replaced r WHERE r.session_id = e.session_id AND e.seq BETWEEN r.start_seq AND r.end_seq AND e.seq < r.r)",
    "compaction_overlap": f"""WITH {REPLACED_SQL}, {RECORDS_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_seq, r) AS range_no FROM replaced)
SELECT seg.session_id, segment_id, min(range_no) AS range_no FROM seg JOIN numbered n ON n.session_id = seg.session_id AND first_seq <= n.end_seq + 2 AND last_seq >= n.start_seq GROUP BY ALL""",
    "tool_pair_antijoin": """WITH c AS (SELECT DISTINCT session_id, call_id FROM session_events WHERE event_type = 'assistant/message' AND call_id IS NOT NULL AND session_id IS NOT NULL),
r AS (SELECT DISTINCT session_id, call_id FROM session_events WHERE event_type = 'tool/result' AND call_id IS NOT NULL AND session_id IS NOT NULL)
SELECT *, 'call' AS side FROM (FROM c EXCEPT FROM r) UNION ALL SELECT *, 'result' FROM (FROM r EXCEPT FROM c)""",
    "call_budget": """SELECT session_id, turn, tool_name, min(seq) AS seq FROM session_events WHERE event_type = 'tool/result' AND tool_name IS NOT NULL AND session_id IS NOT NULL GROUP BY ALL""",
    "manifest_groups": f"""WITH {RECORDS_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first_seq, segment_id) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM seg),
leveled AS (SELECT *, unnest(range(0, CASE WHEN n > 1 THEN CAST(ceil(ln(n) / ln(4) - 1e-9) AS BIGINT) ELSE 0 END + 1)) AS level FROM placed)
SELECT session_id, level, CAST(floor(i / pow(4, level)) AS BIGINT) AS node, min(first_seq) AS first_seq, max(last_seq) AS last_seq FROM leveled GROUP BY ALL""",
    "request_attributes": f"""SELECT session_id, coalesce(role, 'unknown') AS role, coalesce(source.kind, 'unknown') AS source_kind, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars, CAST(sum({t.sql_estimate("content")}) AS BIGINT) AS tokens
FROM session_events WHERE content IS NOT NULL AND session_id IS NOT NULL GROUP BY ALL""",
    "latest_capture": "SELECT session_id, event_type AS kind, max(seq) AS sequence FROM session_events WHERE event_type IS NOT NULL AND session_id IS NOT NULL GROUP BY ALL",
    "ledger_replay": LIVE_SQL + "SELECT scope_kind, scope_id, collection, id, value_json FROM ranked WHERE n = 1 AND NOT gone",
    "ledger_scope_counts": LIVE_SQL + "SELECT scope_kind, collection, count(*) FILTER (value_json->>'$.tombstonedAt' IS NULL) AS live, count(*) FILTER (value_json->>'$.tombstonedAt' IS NOT NULL) AS tombstoned FROM ranked WHERE n = 1 AND NOT gone GROUP BY ALL",
    "ledger_scan": LIVE_SQL + "SELECT scope_kind, scope_id, id FROM ranked WHERE n = 1 AND NOT gone AND collection = 'sensoryChunks' AND value_json->>'$.tombstonedAt' IS NULL",
    "reference_sync": LIVE_SQL.rstrip() + """, state AS (SELECT *, value_json->>'$.tombstonedAt' IS NULL AS live FROM ranked WHERE n = 1 AND NOT gone),
r AS (SELECT scope_id AS workspace_id, id AS record_id FROM state WHERE collection = 'semipersistentRecords' AND scope_kind = 'workspace' AND live),
p AS (SELECT split_part(id, '@', 1) AS record_id, split_part(id, '@', 2) AS session_id, live FROM state WHERE collection = 'semipersistentProjections'),
s AS (SELECT DISTINCT workspace_id, session_id FROM session_events WHERE workspace_id IS NOT NULL AND session_id IS NOT NULL)
SELECT record_id, session_id, 'create' AS action FROM r JOIN s USING (workspace_id) ANTI JOIN p USING (record_id, session_id) UNION ALL SELECT record_id, session_id, 'delete' FROM p ANTI JOIN r USING (record_id) WHERE live""",
    "association_dedupe": USES_SQL + " SELECT item_id, session_id, turn, used_at FROM uses",
    "activation": FACTS_SQL + " SELECT item_id, round(activation, 6) AS activation, strong_recent, strong, sessions, last_turn FROM facts",
    "layer_decisions": FACTS_SQL + f""" SELECT item_id, strong_recent >= 2 AS to_semi, strong >= 3 AND sessions >= 2 AS to_bank,
  ({TURN_NOW} - last_turn >= 12 OR (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_at)) / 3.6e9 >= 24) AND activation < -1.5 AS expires FROM facts""",
    "supersede": rf"""
WITH p AS ({t.SQL_PARENTS}), o AS (SELECT session_id, parent_id, core_text, row_number() OVER (PARTITION BY session_id ORDER BY updated_at NULLS FIRST, parent_no) AS position FROM p WHERE session_id IS NOT NULL),
x AS (SELECT o.*, child_id, substring(core_text, greatest(0, start_offset) + 1, end_offset - greatest(0, start_offset)) AS text, vector FROM ({t.SQL_CHILDREN}) JOIN o USING (parent_id) WHERE start_offset IS NOT NULL),
c AS (SELECT *, list_filter({t.sql_tokens("text")}, lambda k: regexp_matches(k, '^[\x{{3400}}-\x{{9fff}}]+$') AND length(k) >= 2 OR length(k) >= 3 AND NOT regexp_matches(k, '^\d+$')) AS tokens FROM x WHERE text <> ''),
n AS (SELECT * FROM c WHERE regexp_matches(trim(core_text), '{text.UPDATE}') AND length(trim(core_text)) <= 1024 AND NOT regexp_matches(trim(core_text), '(?m)^---\s+.+\s+---$'))
SELECT o.session_id, o.child_id AS old_child_id, n.child_id AS new_child_id FROM n JOIN c o ON n.session_id = o.session_id AND o.position < n.position AND o.parent_id <> n.parent_id AND o.text <> n.text
WHERE len(list_intersect(n.tokens, o.tokens)) >= 2 AND CASE WHEN n.vector IS NOT NULL AND o.vector IS NOT NULL THEN coalesce({t.sql_cosine("n.vector", "o.vector")}, 0) >= 0.45 ELSE len(list_intersect(n.tokens, o.tokens)) >= 3 END
QUALIFY row_number() OVER (PARTITION BY o.session_id, o.child_id ORDER BY n.position, n.child_id) = 1""",
    "layer_counts": f"""SELECT workspace_id, count(*) AS parents, count(*) FILTER (coalesce(temporal_current, true)) AS current, count(*) FILTER (vector_state = 'active') AS active, count(*) FILTER (vector_state = 'pending-vector') AS pending, CAST(coalesce(sum(n), 0) AS BIGINT) AS children
FROM ({t.SQL_PARENTS}) LEFT JOIN (SELECT parent_id, count(*) AS n, max(vector_state) AS vector_state FROM (SELECT child_no, max(parent_id) AS parent_id, max(vector_state) AS vector_state FROM child_spans GROUP BY child_no) GROUP BY parent_id) USING (parent_id) GROUP BY workspace_id""",
    "count_by": "SELECT coalesce(court_name, 'unknown') AS value, count(*) AS n FROM documents GROUP BY ALL",
    "cube_counts": "SELECT lang, source, count(*) AS n, grouping_id(lang, source) AS level FROM documents GROUP BY CUBE (lang, source)",
    "distinct_layers": LIVE_SQL + "SELECT collection, scope_id, id, max(mutation_seq) AS mutation_seq FROM ranked WHERE n = 1 AND NOT gone AND collection IN ('sensoryChunks', 'sourceSegments', 'bankChunks', 'semipersistentRecords') GROUP BY ALL",
    "bank_visible": LIVE_SQL + """SELECT scope_kind, scope_id, id FROM ranked WHERE n = 1 AND NOT gone AND collection = 'bankChunks' AND (scope_kind = 'workspace' AND scope_id = 'ws-hub' OR scope_kind = 'user-global')
  AND coalesce(value_json->>'$.verifiedSource', 'true') = 'true' AND coalesce(value_json->>'$.temporalCurrent', 'true') = 'true' AND value_json->>'$.supersededBy' IS NULL AND value_json->>'$.tombstonedAt' IS NULL""",
    "stream_ttl": """WITH e AS (SELECT session_id, event_time AS t, lag(event_time) OVER (PARTITION BY session_id ORDER BY event_time) AS before FROM session_events WHERE event_time IS NOT NULL),
n AS (SELECT *, count(*) FILTER (before IS NULL OR t >= before + INTERVAL 24 HOUR) OVER (PARTITION BY session_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS stretch FROM e)
SELECT session_id, min(t) AS start, max(t) + INTERVAL 24 HOUR AS "end", count(*) AS n FROM n GROUP BY session_id, stretch HAVING max(t) + INTERVAL 24 HOUR <= (SELECT max(event_time) - INTERVAL 1 DAY FROM session_events)""",
    "stream_ledger": P1_SQL,
    "stream_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY ALL",
}
