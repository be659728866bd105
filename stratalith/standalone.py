"""One session's memory without a host: observations go in turn by turn, notes that fit a budget come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.api import Memory, ledger_counts
from stratalith.config import Config
from stratalith.functions import text
from stratalith.functions.vector import Encoder
from stratalith.operators import match, surface
from stratalith.operators.render import tokens
from stratalith.sources.ledger import Ledger

EVENT = "session_id string, seq bigint, event_type string, turn bigint"
QUERY = "query_id bigint, scope string, text string, vector array<double>, vector_model string"
TABLE = "session_id string, workspace_id string, turn bigint, seq bigint, text string"


class StandaloneMemory:
    """The latest observation stays as it is; when the next one arrives, it is stored in parents and children.

    Notes are whole parents. All that the driver holds is the latest observation, the ids last offered, and counters.
    """

    def __init__(self, spark: SparkSession, path: str, session_id: str, workspace_id: str = "local", max_tokens: int = 8192, config: Config = Config(), encoder: Encoder | None = None):
        self.spark, self.session_id, self.workspace_id, self.max_tokens = spark, session_id, workspace_id, max(1, max_tokens)
        none = spark.createDataFrame([], EVENT)
        self.memory = Memory(spark, Ledger(spark, path), none, none, none, config=config, encoder=encoder)
        self.turn, self.original_tokens, self.closed, self._latest, self._offered = 0, 0, False, None, None

    def _open(self) -> None:
        if self.closed:
            raise RuntimeError("this memory is closed")

    def ready(self) -> dict:
        self._open()
        self.memory.encoder.health()
        return {"ready": True, "model": self.memory.encoder.model}

    def _query(self, query: str) -> DataFrame:
        rows = self.spark.createDataFrame([(1, self.session_id, query, None, None)], QUERY)
        encoder = self.memory.encoder
        return encoder.vectors(rows.drop("vector", "vector_model"), "text").withColumn("vector_model", F.lit(encoder.model))

    def _match(self, query: str, budget: int) -> tuple[dict, dict]:
        """The stages' result, and notes from the selected parents that fit the budget."""
        stages = match.Retrieval(self._query(query), *self.memory.candidates(), config=self.memory.config)
        result = stages.result.collect()[0].asDict()
        self._offered = (query, [r["parent_id"] for r in stages.parents.orderBy("parent_rank").select("parent_id").collect()])  # at most parent_eligible_limit
        return result, self._notes(stages.picks.join(stages.parents.select("query_id", "parent_id", "view"), ["query_id", "parent_id"]), budget)

    def _notes(self, picks: DataFrame, budget: int) -> dict:
        kept = surface.skipping(picks, ["query_id"], ["pick"], text.estimate_tokens(F.col("view")) + 24, F.lit(max(0, budget))).filter("accepted")
        rows = kept.orderBy("pick").collect()  # at most parent_select_limit
        notes = "\n\n".join(r["view"] for r in rows)
        return {"notes": notes, "tokens": tokens(notes), "selected": [r["parent_id"] for r in rows]}

    def manage(self, observation: str, question: str | None = None) -> dict:
        """Take an observation in; the content to show: notes from earlier turns and the observation, within the budget."""
        self._open()
        if self._latest is not None:
            self.memory.store(self.spark.createDataFrame([(self.session_id, self.workspace_id, self.turn, self.turn, self._latest)], TABLE))
        self.turn, self._latest = self.turn + 1, observation
        self.original_tokens += tokens(observation)
        shown = text.clip(observation, self.max_tokens)
        result, notes = self._match(question or observation, self.max_tokens - tokens(shown) - 32)
        content = [x for x in (notes["notes"], shown) if x]
        used = tokens("\n\n".join(content))
        ratio = used / self.original_tokens if self.original_tokens else 1.0
        return {"content": content, "tokens": used, "original_tokens": self.original_tokens, "compression_ratio": ratio, "was_compacted": self.turn > 1, "turn": self.turn, "retrieved": notes["selected"], "needs_planner": result["needs_planner"]}

    def retrieve(self, query: str, budget: int | None = None) -> dict:
        """Notes for a query; where the result doesn't suffice, the candidates for a planner (at most 8)."""
        self._open()
        result, notes = self._match(query, self.max_tokens if budget is None else budget)
        return {"query": query, **notes, "needs_planner": result["needs_planner"], "reasons": result["reasons"], "planner_candidates": self._offered[1][:8] if result["needs_planner"] else []}

    def verify_plan(self, ids: list[str], resolved: str | None = None, budget: int | None = None) -> dict:
        """Notes from the candidates that a planner picked, after they are ranked again by the resolved query."""
        self._open()
        if self._offered is None:
            raise RuntimeError("retrieve must be called before verify_plan")
        query, offered = self._offered
        picked = self.spark.createDataFrame([(1, i) for i in dict.fromkeys(ids) if i in offered], "query_id bigint, parent_id string")
        rows = self.memory.verify(self._query(resolved or query), picked, self.memory.candidates())
        margin = rows.agg(F.max("margin")).collect()[0][0]
        notes = self._notes(rows.withColumn("pick", F.col("place")), self.max_tokens if budget is None else budget)
        return {"query": query, **notes, "verified": margin is not None, "margin": margin or 0.0, "resolved_query": resolved or query}

    def stats(self) -> dict:
        self._open()
        children, parents = self.memory.candidates()
        n, active = parents.agg(F.count("*"), F.count_if("eligible")).collect()[0]
        kids = children.count()
        return {"session_id": self.session_id, "turn": self.turn, "parents": n, "active_parents": active, "children": kids, "children_per_parent": kids / n if n else 0.0, "layers": [r.asDict() for r in ledger_counts(self.memory.ledger.state()).collect()], "model": self.memory.encoder.model}

    def close(self) -> dict:
        already, self.closed = self.closed, True
        if not already:
            self.memory.ledger.flush()
        return {"closed": True, "already_closed": already}
