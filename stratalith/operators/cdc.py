"""A keyed table kept by bucketed copy-on-write, and the change feed that is applied to it.

Rows are hashed by key into buckets, as many as the bytes ask for. A manifest names the files of each bucket. Applying
changes (1) reads the feed once and reduces it to one row per key, so that repeated lines and hot keys shrink before they
are shuffled, (2) routes that to buckets by the same hash, (3) reads the files of touched buckets only, as a bucketed
scan that keeps their partitioning, so the base isn't shuffled, and sorts and merges each bucket, (4) writes replacement
files into a directory of their own and (5) commits a new manifest by an atomic create. A failed or repeated task leaves
at most files that no manifest names. A table that has outgrown its buckets is rewritten with twice as many or more.

Deleted keys stay in the files as markers, so that a later feed with older changes can't bring them back.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalith import storage

SEQ, AT, GONE, BUCKET, ORDER = "__cdc_seq", "__cdc_at", "__cdc_gone", "__cdc_bucket", "__cdc_order"
#: Bytes of a bucket's files at which the number of buckets is chosen; a table grows at twice that. The least number.
BUCKET_BYTES, LEAST_BUCKETS = 128 << 20, 16
#: How a bucketed file names its bucket (fixed pattern of the file format's writer).
BUCKET_FILE = re.compile(r"_(\d+)(?:\..*)?$")

#: Kinds of change, as spelled in the feed (fixed values).
WRITES = ("insert", "update", "upsert")
DELETES = ("delete",)


@dataclass(frozen=True)
class ChangeSpec:
    """``keys`` identify a record (null is a value of its own), ``payload`` is carried along."""

    keys: tuple[str, ...]
    payload: tuple[str, ...]


def changes(df: DataFrame, spec: ChangeSpec, seq: Column, at: Column, gone: Column) -> DataFrame:
    """The columns that the table keeps. A null ``seq`` orders before every number, a null ``at`` before every time."""
    return df.select(
        *spec.keys,
        *spec.payload,
        seq.cast("bigint").alias(SEQ),
        at.cast("timestamp_ntz").alias(AT),
        F.coalesce(gone, F.lit(False)).alias(GONE),
    )


def latest(df: DataFrame, spec: ChangeSpec) -> DataFrame:
    """One row per key: the highest sequence, then the latest time, then a delete before a write, then the payload's hash."""
    order = F.struct(SEQ, AT, GONE, F.xxhash64(*spec.payload, F.lit(0)).alias("h"))
    best = F.max_by(F.struct(SEQ, AT, GONE, *spec.payload), order)
    grouped = df.groupBy(*spec.keys).agg(best.alias(ORDER))
    return grouped.select(*spec.keys, *(F.col(ORDER)[c].alias(c) for c in (*spec.payload, SEQ, AT, GONE)))


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, spec: ChangeSpec):
        self.spark, self.path, self.spec = spark, path.rstrip("/"), spec

    @classmethod
    def create(cls, base: DataFrame, path: str, spec: ChangeSpec, buckets: int | None = None, bucket_bytes: int = BUCKET_BYTES) -> BucketedTable:
        """``base`` has the columns of :func:`changes`; its keys may repeat. ``buckets`` is the number to begin with, else
        it follows from the bytes."""
        table = cls(base.sparkSession, path, spec)
        columns = [*spec.keys, *spec.payload, SEQ, AT, GONE]
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in base.select(*columns).schema])
        empty = {"version": 0, "buckets": buckets or 0, "bucket_bytes": bucket_bytes, "schema": schema.jsonValue(), "files": {}, "bytes": {}, "batches": {}, "last": None}
        table._commit(empty)
        table.apply(base)
        return table

    # manifest

    def _file(self, version: int) -> str:
        return f"{self.path}/manifest/{version:012d}.json"

    def _commit(self, manifest: dict) -> None:
        """Fails if another writer has made this version. Readers see the old manifest or the whole new one."""
        fs, folder = storage.filesystem(self.spark, f"{self.path}/manifest")
        fs.mkdirs(folder)
        if not storage.create_once(self.spark, self._file(manifest["version"]), json.dumps(manifest)):
            raise RuntimeError(f"version {manifest['version']} of {self.path} was committed by another writer")

    def manifest(self, version: int | None = None) -> dict:
        if version is None:
            fs, folder = storage.filesystem(self.spark, f"{self.path}/manifest")
            names = [s.getPath().getName() for s in fs.listStatus(folder)]
            version = max(int(n[:-5]) for n in names if n.endswith(".json") and n[0] != ".")
        return json.loads(storage.read_text(self.spark, self._file(version)))

    # reading

    def bucket(self, buckets: int) -> Column:
        """The bucket of a row: the same hash as that of a shuffle by the keys into so many partitions."""
        return F.pmod(F.hash(*self.spec.keys), F.lit(buckets)).cast("int")

    def _scan(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        """The rows of some buckets, or of all. The scan has one task per bucket and keeps the keys' partitioning."""
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/data/{f}" for b, fs in manifest["files"].items() if buckets is None or int(b) in buckets for f in fs]
        return _bucketed(self.spark, paths, schema, manifest["buckets"], self.spec.keys) if paths else self.spark.createDataFrame([], schema)

    def rows(self, version: int | None = None, deleted: bool = False) -> DataFrame:
        """The live records of a version (the newest if none is named), or all with their markers."""
        df = self._scan(self.manifest(version))
        return df if deleted else df.filter(~F.col(GONE)).drop(GONE)

    def last_sequence(self) -> int | None:
        """The highest sequence applied so far, from the manifest alone."""
        return self.manifest()["last"]

    # writing

    def apply(self, feed: DataFrame, batch: int | None = None, stream: str = "") -> int:
        """Apply a feed with the columns of :func:`changes`; returns the version that holds it.

        Order within the feed and between feeds doesn't matter. The batches of a stream are numbered upwards; one that was
        applied already changes nothing.
        """
        now = self.manifest()
        if batch is not None and batch <= now["batches"].get(stream, -1):
            return now["version"]
        schema = T.StructType.fromJson(now["schema"])
        feed = feed.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
        reduced = storage.materialize(latest(feed, self.spec), "reduced")
        n, size = now["buckets"], storage.total_bytes(self.spark, reduced._written_to) + sum(now["bytes"].values())
        grown = n
        if not n or size > 2 * n * now["bucket_bytes"]:
            grown = max(LEAST_BUCKETS, n)
            while grown * now["bucket_bytes"] < size:
                grown *= 2
        # At most one row for each bucket reaches the driver; only the key columns are read for it.
        facts = reduced.groupBy(self.bucket(grown).alias(BUCKET)).agg(F.max(SEQ).alias("last")).collect()
        if not facts:
            storage.release(reduced)
            return now["version"]
        touched = {r[0] for r in facts}
        routed = reduced.repartition(grown, *self.spec.keys)
        if grown != n and now["files"]:  # outgrown: every bucket is rewritten, the only time that the base is shuffled
            touched, merged = set(range(grown)), latest(self._scan(now).unionByName(reduced).repartition(grown, *self.spec.keys), self.spec)
        elif any(str(b) in now["files"] for b in touched):
            merged = latest(self._scan(now, sorted(touched)).unionByName(routed), self.spec)
        else:
            merged = routed
        files, sizes = self._write(merged, grown, f"{now['version'] + 1:012d}-{uuid.uuid4().hex}")
        keep = lambda old: {b: v for b, v in old.items() if int(b) not in touched}
        last = max((x for x in (now["last"], *(r[1] for r in facts)) if x is not None), default=None)
        batches = now["batches"] if batch is None else now["batches"] | {stream: batch}
        self._commit(now | {"version": now["version"] + 1, "buckets": grown, "files": keep(now["files"]) | files, "bytes": keep(now["bytes"]) | sizes, "batches": batches, "last": last})
        storage.release(reduced)
        return now["version"] + 1

    def _write(self, rows: DataFrame, n: int, where: str) -> tuple[dict, dict]:
        """Write rows that are partitioned by the keys, one file per bucket; the files and bytes of each."""
        name, folder = f"stratalith_{uuid.uuid4().hex}", f"{self.path}/data/{where}"
        rows.write.format("parquet").bucketBy(n, *self.spec.keys).sortBy(*self.spec.keys).option("path", folder).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # external: the files stay
        fs, path = storage.filesystem(self.spark, folder)
        files, sizes = {}, {}
        for status in fs.listStatus(path):
            file = status.getPath().getName()
            if file[0] not in "._":
                b = str(int(BUCKET_FILE.search(file).group(1)))
                files.setdefault(b, []).append(f"{where}/{file}")
                sizes[b] = sizes.get(b, 0) + status.getLen()
        return files, sizes

    def vacuum(self) -> int:
        """Remove data directories that the newest manifest doesn't name; older versions can't be read afterwards."""
        keep = {f.split("/")[0] for fs in self.manifest()["files"].values() for f in fs}
        fs, folder = storage.filesystem(self.spark, f"{self.path}/data")
        gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in keep] if fs.exists(folder) else []
        for path in gone:
            fs.delete(path, True)
        return len(gone)


def _bucketed(spark: SparkSession, paths: list[str], schema: T.StructType, n: int, keys: tuple[str, ...]) -> DataFrame:
    """A scan of named bucket files that the planner knows to be partitioned by the keys, without a catalog table."""
    jvm, session = spark._jvm, spark._jsparkSession

    def seq(items):
        out = jvm.java.util.ArrayList()
        for item in items:
            out.add(item)
        return jvm.scala.jdk.javaapi.CollectionConverters.asScala(out).toSeq()

    module = lambda package, name: getattr(getattr(package, f"{name}$"), "MODULE$")
    sources, none = jvm.org.apache.spark.sql.execution.datasources, jvm.scala.Option.empty()
    empty, kind = module(jvm.scala.collection.immutable, "Map").empty(), jvm.org.apache.spark.sql.types.DataType.fromJson(schema.json())
    index = sources.InMemoryFileIndex(session, seq(jvm.org.apache.hadoop.fs.Path(p) for p in paths), empty, jvm.scala.Option.apply(kind), module(sources, "NoopCache"), none, none)
    spec = jvm.org.apache.spark.sql.catalyst.catalog.BucketSpec(n, seq(keys), seq(keys))
    relation = sources.HadoopFsRelation(index, jvm.org.apache.spark.sql.types.StructType(), kind, jvm.scala.Option.apply(spec), sources.parquet.ParquetFileFormat(), empty, session)
    return DataFrame(session.baseRelationToDataFrame(relation), spark)


# The journal of scoped collections

LEDGER = ChangeSpec(("scope_kind", "scope_id", "collection", "id"), ("value_json",))
LEDGER_VERSION = 2
DEFAULT_SCOPE = "session"


def squeezed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def ledger_changes(journal: DataFrame) -> DataFrame:
    """Lines that count, in the form of :func:`changes`.

    A line counts if its version is 2, collection and id are neither null nor blank and its op, trimmed and in lower
    case, is a known one. A null ``scope_kind`` means ``session``; a null ``scope_id`` is a value of its own. A null
    ``mutation_seq`` orders before every number. Extra columns are ignored.
    """
    op = F.lower(squeezed(F.col("op")))
    lines = journal.select("ledger_version", "mutation_seq", "scope_kind", "scope_id", "collection", "op", "id", "value_json", "logged_at")
    lines = lines.filter(
        (F.col("ledger_version") == LEDGER_VERSION)
        & (squeezed(F.col("collection")) != "")
        & (squeezed(F.col("id")) != "")
        & op.isin(*WRITES, *DELETES)
    ).withColumn("scope_kind", F.coalesce("scope_kind", F.lit(DEFAULT_SCOPE)))
    return changes(lines, LEDGER, F.col("mutation_seq"), F.col("logged_at"), op.isin(*DELETES))


def ledger_base(snapshot: DataFrame) -> DataFrame:
    """Snapshot rows as writes with their sequence; of a line with the same sequence the line holds."""
    rows = snapshot.select("scope_kind", "scope_id", "collection", "id", "mutation_seq", "value_json")
    rows = rows.withColumn("scope_kind", F.coalesce("scope_kind", F.lit(DEFAULT_SCOPE)))
    return changes(rows, LEDGER, F.col("mutation_seq"), F.lit(None), F.lit(False))


def rebuild_ledger(snapshot: DataFrame, journal: DataFrame, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """Live records after the journal: keys, ``mutation_seq`` of the line that decided, ``value_json``, ``logged_at``.

    Empty inputs give an empty table. Repeated rows change nothing.
    """
    spark = journal.sparkSession
    table = BucketedTable.create(ledger_base(snapshot), path or storage.new_path(spark, "ledger"), LEDGER, buckets)
    table.apply(ledger_changes(journal))
    return table.rows().select(*LEDGER.keys, F.col(SEQ).alias("mutation_seq"), "value_json", F.col(AT).alias("logged_at"))
