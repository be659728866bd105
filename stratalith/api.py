"""The engine as one object: tables in, tables out. Names follow the tools that a conversational host calls."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalith import storage
from stratalith.config import Config
from stratalith.functions import text
from stratalith.functions.vector import Encoder, hash_encoder
from stratalith.operators import cdc, chunker, layers, match, render, segment, surface
from stratalith.sources.ledger import Ledger, lookup, scan

#: What is read of a record's JSON, by its name there.
RECORD = {
    "label": "string", "coreText": "string", "firstSeq": "bigint", "lastSeq": "bigint", "evidenceQuality": "double", "state": "string", "vectorState": "string", "segmentId": "string", "workspaceId": "string",
    "supersededBy": "string", "bankRecordId": "string", "recordId": "string", "verifiedSource": "boolean", "temporalCurrent": "boolean", "tombstonedAt": "string",
}
CHILD = "array<struct<childId string, startOffset int, endOffset int, embeddingTextPreview string, vector array<double>, vectorModel string, temporalCurrent boolean, supersededBy string>>"
KEYS = ["scope_kind", "scope_id", "id"]


def snake(name: str) -> str:
    return re.sub("[A-Z]", lambda m: "_" + m[0].lower(), name)


def edited(value: Column, fields: dict[str, Column]) -> Column:
    """A JSON object with some fields set (each a column of JSON text); all others keep their values and types."""
    old = F.coalesce(F.try_variant_get(F.try_parse_json(value), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    new = F.create_map(*(x for name, v in fields.items() for x in (F.lit(name), F.parse_json(v))))
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, _: ~k.isin(*fields)), new))


def millis() -> Column:
    return F.unix_millis(F.current_timestamp()).cast("string")


class Memory:
    """``events`` is the session log, ``ledger`` holds the collections ``sensoryChunks``, ``sourceSegments``,
    ``semipersistentRecords``, ``semipersistentProjections``, ``bankChunks`` and ``sessionState``, ``parents`` and
    ``children`` the chunked tables of :mod:`match`."""

    def __init__(self, spark: SparkSession, ledger: Ledger, events: DataFrame, parents: DataFrame, children: DataFrame, bank: tuple[DataFrame, DataFrame] | None = None, config: Config = Config(), mode: str = "full", planner: Callable[[str], str] | None = None, encoder: Encoder | None = None):
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        self.spark, self.ledger, self.events, self.parents, self.children, self.bank, self.config, self.mode, self.planner = spark, ledger, events, parents, children, bank, config, mode, planner
        self.encoder, self._plans = encoder or hash_encoder(), {}

    def _records(self, collection: str, scope_kind: str | None = None, scope_id: str | None = None) -> DataFrame:
        shape = ", ".join(f"{k} {v}" for k, v in RECORD.items())
        rows = scan(self.ledger.state(), collection, scope_kind, scope_id).withColumn("r", F.from_json("value_json", shape))
        return rows.select(*KEYS, "mutation_seq", "value_json", *(F.col(f"r.{k}").alias(snake(k)) for k in RECORD))

    def _upsert(self, collection: str, rows: DataFrame) -> int:
        """``scope_kind, scope_id, id, value_json``."""
        return self.ledger.upsert(rows.select(*KEYS, "value_json").withColumn("collection", F.lit(collection)))

    def candidates(self) -> tuple[DataFrame, DataFrame]:
        """Children and parents of the stored sensory records, by session, as :mod:`match` takes them. A record without
        children stands for one itself; superseded children are left out."""
        rows = self._records("sensoryChunks").filter("coalesce(temporal_current, true) and superseded_by is null")
        got = lambda path: F.get_json_object("value_json", path)
        quality = F.coalesce("evidence_quality", F.when(F.col("verified_source"), 0.9).otherwise(0.0))
        reason = match.eligibility(F.col("core_text"), F.size(F.from_json(got("$.sourceRefs"), "array<string>")), quality, F.coalesce(got("$.conflict").cast("boolean"), F.lit(False)), F.lit(True), F.when(F.col("vector_state") == "pending-vector", "pending-vector").otherwise("active"), self.config)
        parents = rows.select(F.col("scope_id").alias("scope"), F.col("id").alias("parent_id"), F.coalesce(got("$.documentId"), "segment_id", "id").alias("document_id"), F.coalesce(got("$.turn").cast("bigint"), F.lit(0)).alias("turn"), (reason == "eligible").alias("eligible"), F.lit(True).alias("source_valid"), F.coalesce(got("$.conflict").cast("boolean"), F.lit(False)).alias("conflict"), got("$.updatedAt").cast("bigint").alias("updated_at"), F.col("core_text").alias("view"))
        found = F.from_json(got("$.childSpans"), CHILD)
        alone = F.array(F.struct(F.concat("id", F.lit(":child:001")).alias("childId"), F.lit(0).alias("startOffset"), F.length("core_text").alias("endOffset"), F.substring("core_text", 1, 240).alias("embeddingTextPreview"), F.lit(None).cast("array<double>").alias("vector"), F.lit(None).cast("string").alias("vectorModel"), F.lit(True).alias("temporalCurrent"), F.lit(None).cast("string").alias("supersededBy"))).cast(CHILD)
        kids = rows.select(F.col("scope_id").alias("scope"), F.col("id").alias("parent_id"), "core_text", F.explode(F.when(F.size(found) > 0, found).otherwise(alone)).alias("c")).filter("coalesce(c.temporalCurrent, true) and c.supersededBy is null")
        text_of = F.coalesce(F.nullif(F.substring("core_text", F.col("c.startOffset") + 1, F.col("c.endOffset") - F.col("c.startOffset")), F.lit("")), F.col("c.embeddingTextPreview"))
        return kids.select("scope", "parent_id", F.col("c.childId").alias("child_id"), text_of.alias("text"), F.col("c.vector").alias("vector"), F.col("c.vectorModel").alias("vector_model")), parents

    # retrieval

    def recall(self, queries: DataFrame, limit: int = 5) -> DataFrame:
        """Selected parents of each query with their current text, at most ``limit`` (1 to 20)."""
        stages = match.Retrieval(queries, self.children, self.parents, config=self.config)
        rows = stages.picks.join(stages.parents.select("query_id", "parent_id", "scope", "view", "relevance"), ["query_id", "parent_id"])
        return rows.filter(F.col("pick") < max(1, min(20, int(limit))))

    def retrieve(self, queries: DataFrame) -> DataFrame:
        """Results of the first stage, with the bank where that doesn't settle a query."""
        if self.bank is None:
            return match.Retrieval(queries, self.children, self.parents, config=self.config).result
        return match.with_fallback(queries, (self.children, self.parents), self.bank, config=self.config)

    def plan(self, query: str, candidates: list[dict], turn: object = None) -> list[str]:
        """Ids that a language model picks, of at most 8 candidates; ids that weren't offered are dropped. With a ``turn``
        the model is asked once for it."""
        if self.planner is None or not candidates:
            return []
        if turn is not None and turn in self._plans:
            return self._plans[turn]
        offered = candidates[:8]
        answer = text.last_json(self.planner(json.dumps({"query": query, "candidates": [{"id": c["id"], "label": c.get("label", "")} for c in offered]})))
        picked = json.loads(answer) if answer else {}
        known = {c["id"] for c in offered}
        ids = [i for i in dict.fromkeys(picked.get("selectedIds", []) if isinstance(picked, dict) else []) if i in known][:8]
        if turn is not None:
            self._plans[turn] = ids
        return ids

    def verify(self, queries: DataFrame, picked: DataFrame, tables: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        """The parents that were picked for a query (``query_id, parent_id``) ranked again by the (resolved) query alone.

        ``query_id, place, parent_id, view, relevance, margin``: only qualified ones, as many as may be selected; a query
        without a row isn't verified. Each query is matched with its picked parents only.
        """
        children, parents = tables or (self.children, self.parents)
        own = picked.join(queries.select("query_id", "scope"), "query_id").select("scope", "parent_id", F.col("query_id").cast("string").alias("own")).distinct()
        narrow = lambda df: df.join(own, ["scope", "parent_id"]).drop("scope").withColumnRenamed("own", "scope")
        ranks = match.Retrieval(queries.withColumn("scope", F.col("query_id").cast("string")), narrow(children), narrow(parents), config=self.config).parents.filter("qualified")
        order = Window.partitionBy("query_id").orderBy("parent_rank")
        rows = ranks.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= self.config.parent_select_limit)
        first = F.first("relevance").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        second = F.coalesce(F.nth_value("relevance", 2).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))
        return rows.select("query_id", "place", "parent_id", "view", "relevance", (first - second).alias("margin"))

    def review(self, record: dict, complete: Callable[[str], str] | None = None) -> dict:
        """A language model's verdict on promoting a record: target, importance, durability, quality.

        Under a confidence of 0.8 the target is ``none``; quality is at most the record's own.
        """
        ask = complete or self.planner
        answer = text.last_json(ask(json.dumps(record))) if ask else None
        got = json.loads(answer) if answer else {}
        got = got if isinstance(got, dict) else {}

        def share(name: str, fallback: float = 0.5) -> float:
            try:
                value = float(got.get(name))
            except (TypeError, ValueError):
                return fallback
            return min(1.0, max(0.0, value)) if value == value else fallback

        target = got.get("target") if got.get("target") in ("semipersistent", "bank") and share("confidence", 0.0) >= 0.8 else "none"
        return {"target": target, "importance": share("importance"), "durability": share("durability"), "evidence_quality": min(share("evidenceQuality"), float(record.get("evidence_quality") or 0.0))}

    def open(self, key: str, session_id: str | None = None, workspace_id: str | None = None, turn: int | None = None) -> DataFrame:
        """A record by ``chunk:id``, id or label, from any layer. With a session and turn the use is noted on the record."""
        key = key.removeprefix("chunk:")
        layers_ = ("sensoryChunks", "bankChunks", "semipersistentRecords")
        rows = [self._records(c).withColumn("collection", F.lit(c)).withColumn("layer", F.lit(i)) for i, c in enumerate(layers_)]
        found = rows[0].unionByName(rows[1]).unionByName(rows[2]).filter((F.col("id") == key) | (F.col("label") == key))
        best = storage.materialize(found.orderBy("layer", "id", "scope_kind", "scope_id").limit(1), "opened")
        if session_id is not None and turn is not None:
            for collection in layers_:
                self._note(collection, best.filter(F.col("collection") == collection), session_id, workspace_id, turn)
        return best.drop("layer")

    def _note(self, collection: str, rows: DataFrame, session_id: str, workspace_id: str | None, turn: int) -> None:
        """Append a use to records; one per session and turn."""
        old = F.coalesce(F.from_json(F.get_json_object("value_json", "$.associations"), "array<string>"), F.array().cast("array<string>"))
        same = F.exists(old, lambda x: (F.get_json_object(x, "$.sessionId") == session_id) & (F.get_json_object(x, "$.turn").cast("bigint") == turn))
        use = F.to_json(F.struct(F.lit(session_id).alias("sessionId"), F.lit(workspace_id).alias("workspaceId"), F.lit(turn).alias("turn"), F.lit(1.0).alias("weight"), F.lit(True).alias("verified"), F.unix_millis(F.current_timestamp()).alias("time")))
        uses = F.concat(F.lit("["), F.array_join(F.concat(old, F.array(use)), ","), F.lit("]"))
        rows = rows.filter(~same).withColumn("value_json", edited(F.col("value_json"), {"associations": uses, "updatedAt": millis()}))
        self._upsert(collection, rows)

    def sources(self, key: str) -> DataFrame:
        """The messages that a record's source references name: ``session_id, seq, role, text``."""
        refs = self.open(key).select(F.explode(F.from_json(F.get_json_object("value_json", "$.sourceRefs"), "array<struct<sessionId string, seq bigint>>")).alias("r")).select(F.col("r.sessionId").alias("session_id"), F.col("r.seq").alias("seq"))
        return segment.records(self.events).join(refs.distinct(), ["session_id", "seq"], "left_semi").select("session_id", "seq", "role", "text")

    def bank_open(self, key: str, workspace_id: str | None = None, session_id: str | None = None, turn: int | None = None) -> DataFrame:
        """A visible record of the bank; with a session and turn the use is noted."""
        found = lookup(self.ledger.state(), "bankChunks", key)
        if workspace_id is not None:
            rows = self._records("bankChunks").withColumnsRenamed({"verified_source": "verified", "temporal_current": "current"})
            found = found.join(layers.bank_visible(rows, workspace_id).select(*KEYS), KEYS, "left_semi")
        found = storage.materialize(found, "opened")
        if session_id is not None and turn is not None:
            self._note("bankChunks", found, session_id, workspace_id, turn)
        return found

    def catalog(self, queries: DataFrame) -> DataFrame:
        rows = self.recall(queries, 20).withColumn("layer", F.lit("sensory"))
        span = self._records("sensoryChunks").select(F.col("id").alias("parent_id"), "first_seq", "last_seq")
        return render.catalog(rows.join(span, "parent_id", "left"))

    # changes

    def put(self, rows: DataFrame, collection: str) -> int:
        """Upsert ``scope_kind, scope_id, id, value_json`` as they are."""
        return self._upsert(collection, rows)

    def _chunked(self, segments: DataFrame) -> DataFrame:
        """Segments (``segment_id, session_id, workspace_id, turn, first_seq, last_seq, refs, text``) as parents with encoded
        children, in the ledger's form; written once."""
        none = F.lit(None).cast("string")
        segments = storage.materialize(segments, "segments")
        parents = storage.materialize(chunker.chunk_table(segments.select(F.col("segment_id").alias("source_id"), none.alias("title"), "text", none.alias("format"), none.alias("language")), self.config), "parents")
        kids = parents.select("parent_id", F.posexplode("children").alias("i", "c")).select("parent_id", "i", "c.*")
        kids = self.encoder.vectors(kids, "embedding_text")
        child = F.struct("i", F.col("child_id").alias("childId"), F.col("start_offset").alias("startOffset"), F.col("end_offset").alias("endOffset"), F.col("token_count").alias("tokenCount"), F.col("embedding_text_preview").alias("embeddingTextPreview"), F.col("vector").cast("array<double>").alias("vector"), F.when(F.col("vector").isNotNull(), F.lit(self.encoder.model)).alias("vectorModel"))
        kids = kids.groupBy("parent_id").agg(F.array_sort(F.collect_list(child)).alias("childSpans"), F.bool_and(F.col("vector").isNotNull()).alias("active"))
        rows = parents.join(kids, "parent_id", "left").join(segments.withColumnRenamed("text", "whole"), F.col("source_id") == F.col("segment_id"))
        state = F.when(F.coalesce("active", F.lit(False)), "active").otherwise("pending-vector")
        value = F.struct(
            F.col("parent_id").alias("id"), text.label(F.col("document_title"), F.col("heading_path"), F.col("core_text"), F.col("parent_id")).alias("label"), F.col("document_id").alias("documentId"), F.col("document_title").alias("documentTitle"), F.col("core_text").alias("coreText"),
            F.col("segment_id").alias("segmentId"), F.col("session_id").alias("sessionId"), F.col("workspace_id").alias("workspaceId"), "turn", F.col("first_seq").alias("firstSeq"), F.col("last_seq").alias("lastSeq"),
            F.transform("refs", lambda r: F.struct(F.col("session_id").alias("sessionId"), r.alias("seq"))).alias("sourceRefs"), F.lit(0.85).alias("evidenceQuality"), F.lit(True).alias("verifiedSource"), F.lit(True).alias("temporalCurrent"),
            F.lit("sensory").alias("state"), state.alias("vectorState"), "childSpans", F.unix_millis(F.current_timestamp()).alias("createdAt"), F.unix_millis(F.current_timestamp()).alias("updatedAt"),
        )
        return rows.select(F.lit("session").alias("scope_kind"), F.col("session_id").alias("scope_id"), F.col("parent_id").alias("id"), F.to_json(value).alias("value_json"))

    def store(self, texts: DataFrame) -> DataFrame:
        """Texts (``session_id, workspace_id, turn, seq, text``) as sensory records: cut into parents, children encoded.

        Returns the ids of what was stored. A text's segment is named after its session and number; null and blank texts
        give no record.
        """
        rows = texts.select(F.concat(F.lit("manual-"), "session_id", F.lit("-"), F.col("seq").cast("string")).alias("segment_id"), "session_id", "workspace_id", "turn", F.col("seq").alias("first_seq"), F.col("seq").alias("last_seq"), F.array("seq").alias("refs"), "text")
        chunks = storage.materialize(self._chunked(rows), "stored")
        self._upsert("sensoryChunks", chunks)
        return chunks.select("scope_id", "id")

    def demote(self, session_id: str, source_seq: int) -> DataFrame:
        """The turn that holds a message becomes sensory records, with its text; one that did already gives no row."""
        log = self.events.filter(F.col("session_id") == session_id)
        turn = segment.segments(log).filter((F.col("first_seq") <= source_seq) & (F.col("last_seq") >= source_seq))
        gone = self._records("sourceSegments", "session", session_id).filter("state <> 'working'").select(F.col("id").alias("segment_id"))
        turn = turn.join(gone, "segment_id", "left_anti").select("session_id", "turn", "segment_id", "first_seq", "last_seq")
        said = segment.in_windows(segment.records(log), log)
        whole = segment.source_text(said, ["session_id", "turn"])
        refs = said.groupBy("session_id", "turn").agg(F.array_sort(F.collect_list("seq")).alias("refs"), F.max("workspace_id").alias("workspace_id"))
        rows = storage.materialize(turn.join(whole, ["session_id", "turn"]).join(refs, ["session_id", "turn"]).withColumnRenamed("source_text", "text"), "demoted")
        chunks = storage.materialize(self._chunked(rows), "stored")
        self._upsert("sensoryChunks", chunks)
        done = F.to_json(F.struct(F.col("segment_id").alias("label"), F.col("segment_id").alias("segmentId"), F.col("first_seq").alias("firstSeq"), F.col("last_seq").alias("lastSeq"), F.lit("sensory").alias("state")))
        self._upsert("sourceSegments", rows.select(F.lit("session").alias("scope_kind"), F.col("session_id").alias("scope_id"), F.col("segment_id").alias("id"), done.alias("value_json")))
        return chunks.select("scope_id", "id")

    def forget(self, target: str, scope: str = "workspace", session_id: str | None = None, workspace_id: str | None = None) -> dict[str, DataFrame]:
        """Mark what an id or text names as deleted; the events stay. Returns the keys, by collection.

        In scope ``session`` the session's sensory records; else the bank's records of the workspace (or ``user-global``),
        and what was made from them: workspace records with their projections, and sensory records.
        """
        hits = lambda rows: rows.filter((F.col("id") == target) | (F.col("label") == target) | F.contains(text.normalize(F.col("core_text")), text.normalize(F.lit(target))))
        bury = lambda rows: rows.withColumn("value_json", edited(F.col("value_json"), {"tombstonedAt": millis(), "updatedAt": millis()}))
        if scope == "session":
            rows = self._records("sensoryChunks", "session", session_id)
            gone = storage.materialize(rows.filter((F.col("id") == target) | (F.col("label") == target) | F.contains("core_text", F.lit(target))).select(*KEYS, "value_json"), "forgotten")
            self._upsert("sensoryChunks", bury(gone))
            return {"sensoryChunks": gone.select(*KEYS)}
        bank = self._records("bankChunks").filter((F.col("scope_kind") == scope) & ((F.col("scope_id") == workspace_id) if scope == "workspace" and workspace_id is not None else F.lit(True)))
        gone = storage.materialize(hits(bank).select(*KEYS, "value_json"), "forgotten")
        semi = storage.materialize(self._records("semipersistentRecords").join(gone.select(F.col("id").alias("bank_record_id")), "bank_record_id", "left_semi").select(*KEYS), "forgotten")
        ids = semi.select(F.col("id").alias("made_of")).distinct()
        shown = storage.materialize(self._records("semipersistentProjections").withColumn("made_of", F.coalesce("record_id", F.split_part("id", F.lit("@"), F.lit(1)))).join(ids, "made_of", "left_semi").select(*KEYS), "forgotten")
        chunks = storage.materialize(self._records("sensoryChunks").join(ids.withColumnRenamed("made_of", "segment_id"), "segment_id", "left_semi").select(*KEYS), "forgotten")
        self._upsert("bankChunks", bury(gone))
        removed = {"semipersistentRecords": semi, "semipersistentProjections": shown, "sensoryChunks": chunks}
        for collection, rows in removed.items():
            self.ledger.delete(rows.withColumn("collection", F.lit(collection)))
        return {"bankChunks": gone.select(*KEYS), **removed}

    def _archive(self, session_id: str, archived: bool) -> None:
        value = json.dumps({"archived": archived})
        self._upsert("sessionState", self.spark.createDataFrame([("session", session_id, session_id, value)], "scope_kind string, scope_id string, id string, value_json string"))

    def freeze(self, session_id: str) -> None:
        """Mark a session as archived: its turns aren't taken up any more until it is unfrozen."""
        self._archive(session_id, True)

    def unfreeze(self, session_id: str) -> None:
        self._archive(session_id, False)

    def frozen(self) -> DataFrame:
        """``session_id`` of the archived sessions."""
        rows = scan(self.ledger.state(), "sessionState").filter(F.get_json_object("value_json", "$.archived") == "true")
        return rows.select(F.col("scope_id").alias("session_id"))

    def clear_workspace_index(self, workspace_id: str) -> int:
        return self.ledger.drop_scope("workspace", workspace_id)

    def drop_session(self, session_id: str) -> int:
        return self.ledger.drop_scope("session", session_id)

    def compact(self) -> int:
        return self.ledger.compact()

    # reports

    def status(self) -> DataFrame:
        """Records of each collection and scope kind, live and soft-deleted."""
        return ledger_counts(self.ledger.state())

    def layer_status(self, session_id: str) -> DataFrame:
        return layers.counts(self._records("sensoryChunks", "session", session_id), "vector_state")

    def cache_status(self) -> DataFrame:
        return layers.counts(self._records("semipersistentProjections"), "state")

    def debug_prompt(self, view: str = "last") -> DataFrame:
        """``last``: messages by role and source; ``working``: without catalogs; ``index``: catalogs only; ``cache``: snapshots only."""
        rows = segment.records(self.events)
        purpose = F.coalesce("purpose", F.lit(""))
        chosen = {"last": F.lit(True), "working": ~purpose.isin(*segment.CATALOG_PURPOSES), "index": purpose.contains("catalog"), "cache": purpose.contains("snapshot")}[view]
        return surface.request_attributes(rows.filter(chosen))


def ledger_counts(state: DataFrame) -> DataFrame:
    gone = F.coalesce(F.get_json_object("value_json", "$.tombstonedAt").isNotNull(), F.lit(False))
    return state.groupBy("scope_kind", "collection").agg(F.count_if(~gone).alias("live"), F.count_if(gone).alias("tombstoned"))


#: The 14 tools and the method that serves each.
TOOLS = {
    "sensory_recall": "recall", "sensory_open": "open", "sensory_store": "store", "sensory_demote": "demote", "sensory_status": "status", "sensory_cache_status": "cache_status",
    "sensory_debug_last_prompt": "debug_prompt", "sensory_debug_cache_prompt": "debug_prompt", "sensory_debug_index_prompt": "debug_prompt", "sensory_debug_working_prompt": "debug_prompt",
    "sensory_clear_workspace_index": "clear_workspace_index", "memory_layer_status": "layer_status", "memory_bank_open": "bank_open", "memory_forget": "forget",
}
#: The tools that each mode offers.
MODES = {"full": tuple(TOOLS), "retrieval-only": ("sensory_recall", "sensory_open"), "compression-only": ()}
#: Parameters of the tools as a host sees them: type, and whether one is required.
PARAMETERS = {
    "sensory_recall": {"query": ("string", True)}, "sensory_open": {"chunk": ("string", True)}, "sensory_store": {"text": ("string", True)}, "sensory_demote": {"sourceSeq": ("number", True)},
    "sensory_clear_workspace_index": {"confirm": ("boolean", True)}, "memory_bank_open": {"record": ("string", True)}, "memory_forget": {"target": ("string", True), "scope": ("string", False)},
}


def schemas(mode: str = "full") -> list[dict]:
    """Name and JSON schema of the parameters of each tool that a mode offers."""
    out = []
    for tool in MODES[mode]:
        asked = PARAMETERS.get(tool, {})
        out.append({"name": tool, "parameters": {"type": "object", "properties": {n: {"type": t} for n, (t, _) in asked.items()}, "required": [n for n, (_, must) in asked.items() if must], "additionalProperties": False}})
    return out


def call(memory: Memory, tool: str, **arguments):
    """Run a tool by its public name, if the mode offers it."""
    if tool not in MODES[memory.mode]:
        raise PermissionError(f"mode {memory.mode} doesn't offer {tool}")
    view = tool.removeprefix("sensory_debug_").removesuffix("_prompt") if tool.startswith("sensory_debug_") else None
    return getattr(memory, TOOLS[tool])(**arguments) if view is None else memory.debug_prompt(view)


def rebuild(spark: SparkSession, snapshot: DataFrame, journal: DataFrame) -> DataFrame:
    """The ledger's live state from its driver tables."""
    return cdc.rebuild_ledger(snapshot, journal)
