"""The append-only ledger: JSON journal and snapshot as sources, a folder of Parquet as the native form.

Native layout: ``journal/`` holds appended mutations, ``table/`` the bucketed copy-on-write state. Mutations are numbered
by the writer, one writer at a time; compaction applies the journal to the table and empties it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalith import storage
from stratalith.operators import cdc

MUTATION = T.StructType(
    [
        T.StructField("ledger_version", T.IntegerType()), T.StructField("mutation_seq", T.LongType()), T.StructField("scope_kind", T.StringType()),
        T.StructField("scope_id", T.StringType()), T.StructField("collection", T.StringType()), T.StructField("op", T.StringType()),
        T.StructField("id", T.StringType()), T.StructField("value_json", T.StringType()), T.StructField("logged_at", T.TimestampNTZType()),
    ]
)


class CorruptJournal(ValueError):
    """A line before the last can't be read."""


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``{version, sequence, scopeKind, scopeId, collection, op, id, value}`` of one file; a broken last line is ignored.

    The file is split among tasks; only the highest broken and the highest valid offset reach the driver.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), "value").filter(F.trim("value") != "")
    parsed = lines.withColumn("v", F.try_parse_json("value"))
    edge = parsed.agg(F.max(F.when(F.col("v").isNull(), F.col("n"))).alias("last_bad"), F.count_if(F.col("v").isNull()).alias("bad"), F.max("n").alias("last")).collect()[0]
    if edge["bad"] > 1 or (edge["bad"] == 1 and edge["last_bad"] != edge["last"]):
        raise CorruptJournal(f"{path}: {edge['bad']} broken lines, one of them not the last")
    v = parsed.filter("v is not null")
    got = lambda p, t: F.try_variant_get("v", f"$.{p}", t)
    return v.select(
        got("version", "int").alias("ledger_version"), got("sequence", "bigint").alias("mutation_seq"), got("scopeKind", "string").alias("scope_kind"), got("scopeId", "string").alias("scope_id"),
        got("collection", "string").alias("collection"), got("op", "string").alias("op"), got("id", "string").alias("id"),
        F.to_json(F.try_variant_get("v", "$.value", "variant")).alias("value_json"), F.lit(None).cast("timestamp_ntz").alias("logged_at"),
    )


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """``{version, collections: {name: [record, ...]}}``; another version is refused."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    version = whole.select(F.variant_get("v", "$.version", "int")).collect()[0][0]
    if version != cdc.LEDGER_VERSION:
        raise ValueError(f"snapshot version {version} is not {cdc.LEDGER_VERSION}")
    rows = whole.select(F.explode(F.variant_get("v", "$.collections", "map<string, array<variant>>")).alias("collection", "rows")).select("collection", F.explode("rows").alias("r"))
    got = lambda p: F.try_variant_get("r", f"$.{p}", "string")
    return rows.select(got("scopeKind").alias("scope_kind"), got("scopeId").alias("scope_id"), "collection", got("id").alias("id"), F.lit(0).cast("bigint").alias("mutation_seq"), F.to_json("r").alias("value_json"))


def tombstoned(value: Column) -> Column:
    return F.get_json_object(value, "$.tombstonedAt").isNotNull()


def scan(state: DataFrame, collection: str, scope_kind: str | None = None, scope_id: str | None = None, deleted: bool = False) -> DataFrame:
    """Records of a collection and scope; soft-deleted ones only if asked for."""
    out = state.filter(F.col("collection") == collection)
    if scope_kind is not None:
        out = out.filter(F.col("scope_kind") == scope_kind)
    if scope_id is not None:
        out = out.filter(F.col("scope_id") == scope_id)
    return out if deleted else out.filter(~F.coalesce(tombstoned(F.col("value_json")), F.lit(False)))


def lookup(state: DataFrame, collection: str, key: str, scope_kind: str | None = None, scope_id: str | None = None) -> DataFrame:
    """The record with an id, soft-deleted or not; without a scope the first by scope."""
    found = scan(state, collection, scope_kind, scope_id, deleted=True).filter(F.col("id") == key)
    return found.orderBy("scope_kind", "scope_id").limit(1)


class Ledger:
    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, compact_after: int = 2000):
        self.spark, self.path, self.compact_after = spark, path.rstrip("/"), max(10, compact_after)
        self.table = cdc.BucketedTable(spark, f"{self.path}/table", cdc.LEDGER)
        fs, where = storage.filesystem(spark, f"{self.path}/table/manifest")
        if not fs.exists(where):
            empty = spark.createDataFrame([], MUTATION)
            self.table = cdc.BucketedTable.create(cdc.ledger_changes(empty), f"{self.path}/table", cdc.LEDGER, buckets)
        facts = self.journal().agg(F.max("mutation_seq"), F.count("*")).collect()[0]
        self._last, self._pending = max(facts[0] or 0, self.table.last_sequence() or 0), facts[1]

    def journal(self) -> DataFrame:
        fs, where = storage.filesystem(self.spark, f"{self.path}/journal")
        return self.spark.read.schema(MUTATION).parquet(f"{self.path}/journal") if fs.exists(where) else self.spark.createDataFrame([], MUTATION)

    def state(self) -> DataFrame:
        """Live records: the table with the journal on top."""
        both = self.table.rows(deleted=True).unionByName(cdc.ledger_changes(self.journal()))
        live = cdc.latest(both, cdc.LEDGER).filter(~F.col(cdc.GONE))
        return live.select(*cdc.LEDGER.keys, F.col(cdc.SEQ).alias("mutation_seq"), "value_json")

    def last_sequence(self) -> int:
        """The last number given. One writer appends at a time, and it knows the number since it opened the ledger."""
        return self._last

    def mutate(self, rows: DataFrame) -> int:
        """Append ``scope_kind, scope_id, collection, op, id, value_json`` in order of ``position``; returns the last number.

        ``position`` (bigint) is the order of the calls; numbers follow it, with its gaps. Rows without that column have
        no order among themselves, so a key must not repeat; they are numbered by key.
        """
        names = ["scope_kind", "scope_id", "collection", "op", "id", "value_json"]
        ordered = "position" in rows.columns
        kept = storage.materialize(rows.select(*names, *(["position"] if ordered else [])), "mutations")
        if ordered:
            least, most, n = kept.agg(F.min("position"), F.max("position"), F.count("*")).collect()[0]
            if kept.filter("position is null").limit(1).count():
                raise ValueError("a row without a position has no place in the journal")
            numbered, used = kept.withColumn("mutation_seq", F.col("position") - F.lit(least or 0) + F.lit(self._last + 1)), (most - least + 1 if n else 0)
        else:
            if kept.groupBy("scope_kind", "scope_id", "collection", "id").count().filter("count > 1").limit(1).count():
                raise ValueError("rows that repeat a key need a position")
            keyed = kept.withColumn("bucket", F.pmod(F.xxhash64("scope_id", "collection", "id"), F.lit(256)))
            sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n"))  # 256 rows
            before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            n = F.row_number().over(Window.partitionBy("bucket").orderBy("scope_kind", "scope_id", "collection", "id"))
            numbered = keyed.join(F.broadcast(sizes.select("bucket", before.alias("before"))), "bucket").withColumn("mutation_seq", F.lit(self._last) + F.col("before") + n)
            n = used = kept.count()
        lines = numbered.withColumn("ledger_version", F.lit(cdc.LEDGER_VERSION)).withColumn("logged_at", F.current_timestamp().cast("timestamp_ntz"))
        lines.select(*(F.col(f.name).cast(f.dataType) for f in MUTATION)).write.mode("append").parquet(f"{self.path}/journal")
        storage.release(kept)
        self._last, self._pending = self._last + used, self._pending + n
        if self._pending >= self.compact_after:
            self.compact()
        return self._last

    def upsert(self, rows: DataFrame) -> int:
        return self.mutate(rows.withColumn("op", F.lit("upsert")))

    def delete(self, keys: DataFrame) -> int:
        return self.mutate(keys.withColumn("op", F.lit("delete")).withColumn("value_json", F.lit(None).cast("string")))

    def drop_scope(self, scope_kind: str, scope_id: str, collections: list[str] | None = None) -> int:
        """One delete for each live record of the scope."""
        rows = self.state().filter((F.col("scope_kind") == scope_kind) & (F.col("scope_id") == scope_id))
        if collections is not None:
            rows = rows.filter(F.col("collection").isin(*collections))
        return self.delete(rows.select(*cdc.LEDGER.keys))

    def compact(self) -> int:
        """Apply the journal to the table, commit, and only then remove the journal.

        A crash in between leaves lines that the table has already; read again, they change nothing.
        """
        version = self.table.apply(cdc.ledger_changes(self.journal()))
        storage.remove(self.spark, f"{self.path}/journal")
        self._pending = 0
        self.flush()
        return version

    def flush(self) -> dict:
        """Write and return the ledger's meta data: version, sequence, buckets."""
        meta = {"version": cdc.LEDGER_VERSION, "sequence": self.last_sequence(), "table": self.table.manifest()["version"]}
        fs, where = storage.filesystem(self.spark, f"{self.path}/meta.json")
        out = fs.create(where, True)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        return meta
