"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Only a local master, whose tasks all run on this machine, gets a
folder of its own where the setting is absent; any other master is refused then.
Lineage is cut by writing a Parquet table there, which survives the loss of any executor.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def needs_shared(master: str) -> bool:
    """Whether tasks of this master may run on other machines or in other processes than the driver's."""
    return not (master == "local" or master.startswith("local["))


def shared_dir(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if needs_shared(spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stratalith-")
        spark.conf.set("spark.checkpoint.dir", root)
        _made.append((spark, root))
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/stratalith/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back: later branches neither recompute it nor depend on executor-local blocks.

    ``done`` are materialized tables that nothing reads any more once this one is written; they are removed.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    for table in done:
        release(table)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(table: DataFrame) -> None:
    """Remove the files of a materialized table whose last reader is done."""
    path = getattr(table, "_written_to", None)
    if path is not None:
        remove(table.sparkSession, path)
        _made[:] = [m for m in _made if m[1] != path]


def filesystem(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def remove(spark: SparkSession, path: str) -> None:
    fs, where = filesystem(spark, path)
    fs.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = filesystem(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with this text, whole or not at all; false if it exists. Of two writers one wins.

    The text is written beside it first. On a local disk the file is then linked to its name, which fails if that is
    taken; elsewhere it is renamed without overwriting, which file systems with atomic renames decide in one step.
    """
    jvm = spark._jvm
    fs, target = filesystem(spark, path)
    _, part = filesystem(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            os.link(part.toUri().getPath(), target.toUri().getPath())
            return True
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
        never = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context.rename(part, target, never)
        return True
    except FileExistsError:
        return False
    except Exception:
        if fs.exists(target):
            return False
        raise
    finally:
        fs.delete(part, False)


def total_bytes(spark: SparkSession, path: str) -> int:
    fs, where = filesystem(spark, path)
    return fs.getContentSummary(where).getLength()


@atexit.register
def _cleanup() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the session may be gone already; the folder's owner then removes it
            pass
