"""Structured Streaming: turn segmentation, pressure eviction, inactivity and the change feed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from stratalith.functions import text
from stratalith.operators.cdc import BucketedTable, ledger_changes
from stratalith.operators.segment import ROLE_OF, block_text

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OPEN = T.StructType([T.StructField("turn", T.LongType()), T.StructField("start_seq", T.LongType()), T.StructField("last_seq", T.LongType()), T.StructField("n_records", T.LongType()), T.StructField("tokens", T.LongType())])
TURN = "session_id string, turn bigint, start_seq bigint, last_seq bigint, n_records bigint, tokens bigint, evicted boolean, in_surface bigint"


def arrivals(events: DataFrame) -> DataFrame:
    """What the stateful operators need of each event."""
    tokens = F.when(F.col("event_type").isin(*ROLE_OF), text.estimate_tokens(block_text(F.col("content")))).otherwise(0)
    return events.filter("session_id is not null and seq is not null").select("session_id", "seq", F.col("event_time").cast("timestamp").alias("event_time"), "event_type", "turn", tokens.cast("bigint").alias("tokens"))


class Turns(StatefulProcessor):
    """Closes a turn at ``turn/end`` or at the next ``turn/start``; evicts it if the session's surface is over the limit.

    State per session: the open turn, and the tokens on the surface. A surface at ``trigger`` gives turns up until it is
    at ``target``. With ``idle_ms`` a timer closes a turn that stays
    open for so long; such a stream never ends by itself.
    """

    def __init__(self, trigger: int, target: int, checkpoint_tokens: int = 80, idle_ms: int | None = None):
        self.trigger, self.target, self.checkpoint_tokens, self.idle_ms = trigger, target, checkpoint_tokens, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN)
        self.surface = handle.getValueState("surface", T.StructType([T.StructField("tokens", T.LongType()), T.StructField("evicting", T.BooleanType())]))

    def _close(self, key) -> tuple | None:
        if not self.open.exists():
            return None
        turn, start, last, n, tokens = self.open.get()
        self.open.clear()
        used, evicting = self.surface.get() if self.surface.exists() else (0, False)
        used += tokens
        evicting = used >= self.trigger or (evicting and used > self.target)
        evicted = evicting and tokens > self.checkpoint_tokens
        if evicted:
            used -= tokens - self.checkpoint_tokens
            evicting = used > self.target
        self.surface.update((used, evicting))
        return (key[0], turn, start, last, n, tokens, evicted, used)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        batch = pd.concat(list(rows)).drop_duplicates("seq").sort_values("seq")
        for r in batch.itertuples():
            if r.event_type == "turn/start":
                out.append(self._close(key))
                self.open.update((None if pd.isna(r.turn) else int(r.turn), int(r.seq), int(r.seq), 0, 0))
            elif self.open.exists():
                turn, start, last, n, tokens = self.open.get()
                if r.event_type == "turn/end":
                    self.open.update((turn, start, int(r.seq), n, tokens))
                    out.append(self._close(key))
                elif r.event_type in ROLE_OF:
                    self.open.update((turn, start, int(r.seq), n + 1, tokens + int(r.tokens)))
        for timer in list(self.handle.listTimers()) if self.idle_ms else []:
            self.handle.deleteTimer(timer)
        if self.idle_ms and self.open.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._frame([self._close(key)])

    def _frame(self, rows: list) -> pd.DataFrame:
        names = [c.split()[0] for c in TURN.split(", ")]
        return pd.DataFrame([r for r in rows if r is not None], columns=names)

    def close(self) -> None:
        pass


def turns(events: DataFrame, trigger: int = 77_000, target: int = 65_000, **settings) -> DataFrame:
    """Closed turns of a stream of session events. Sessions need the RocksDB state store (``ROCKSDB``)."""
    rows = arrivals(events)
    return rows.groupBy("session_id").transformWithStateInPandas(Turns(trigger, target, **settings), outputStructType=TURN, outputMode="Append", timeMode="ProcessingTime" if settings.get("idle_ms") else "None")


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events and their values by window and type; rows later than ``late`` are left out once their window closed."""
    rows = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def idle_sessions(events: DataFrame, gap: str = "24 hours", late: str = "1 day") -> DataFrame:
    """Stretches of activity of each session, closed after a gap without events."""
    rows = events.withColumn("at", F.col("event_time").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.session_window("at", gap).alias("w"), "session_id").agg(F.count("*").alias("n")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def apply_feed(journal: DataFrame, table: BucketedTable, checkpoint: str) -> StreamingQuery:
    """Apply a stream of ledger lines to a table, batch by batch; a batch that is run again changes nothing."""

    def batch(df: DataFrame, number: int) -> None:
        table.apply(ledger_changes(df), batch=number, stream=checkpoint)

    return journal.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
