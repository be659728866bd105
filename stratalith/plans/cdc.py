"""Query and SQL of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalith.operators.cdc import rebuild_ledger

P1_SQL = """
WITH lines AS (
  SELECT coalesce(scope_kind, 'session') AS scope_kind, scope_id, collection, id, mutation_seq, logged_at,
         (lower(trim(op)) = 'delete') AS gone
  FROM ledger_journal
  WHERE ledger_version = 2 AND trim(collection) <> '' AND trim(id) <> ''
    AND lower(trim(op)) IN ('insert', 'update', 'upsert', 'delete')
  UNION ALL
  SELECT coalesce(scope_kind, 'session'), scope_id, collection, id, mutation_seq, NULL, false FROM ledger_snapshot
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY scope_kind, scope_id, collection, id
    ORDER BY mutation_seq DESC NULLS LAST, logged_at DESC NULLS LAST, gone DESC) AS n
  FROM lines
)
SELECT scope_kind, scope_id, collection, id, mutation_seq FROM ranked WHERE n = 1 AND NOT gone
"""


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot = spark.read.parquet(f"{sf_dir}/ledger_snapshot.parquet")
    journal = spark.read.parquet(f"{sf_dir}/ledger_journal.parquet")
    return rebuild_ledger(snapshot, journal).select("scope_kind", "scope_id", "collection", "id", "mutation_seq")


QUERIES = {"p1_found": p1_found}
SQL = {"p1_found": P1_SQL}
