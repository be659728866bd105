"""Driver tables in the form that the operators take, and SQL fragments that mean the same in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.functions import text
from stratalith.operators import match


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PARENT_COLUMNS = ("parent_id", "session_id", "workspace_id", "document_id", "document_title", "core_text", "evidence_quality", "temporal_current", "updated_at")


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per parent; of repeated rows the greatest value of each column."""
    return table(spark, sf_dir, "parent_chunks").groupBy("parent_no").agg(*(F.max(c).alias(c) for c in PARENT_COLUMNS))


def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "child_spans").select("child_no", "child_id", "parent_id", "start_offset", "end_offset", "embedding_text_preview", "vector", "vector_model", "vector_state")
    return rows.groupBy("child_no").agg(F.max(F.struct(*rows.columns[1:])).alias("c")).select("child_no", "c.*")


def match_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parents(spark, sf_dir).filter("workspace_id is not null")
    reason = match.eligibility(F.col("core_text"), F.lit(1), F.col("evidence_quality"), F.lit(False), F.col("temporal_current"), F.lit("active"))
    return rows.select(F.col("workspace_id").alias("scope"), "parent_id", "document_id", F.lit(None).cast("bigint").alias("turn"), (reason == "eligible").alias("eligible"), F.lit(True).alias("source_valid"), F.lit(False).alias("conflict"), "updated_at", F.col("core_text").alias("view"))


def child_text() -> Column:
    """The child's slice of ``core_text``, to its end without an end offset; the preview, which is cut, only where that is empty."""
    core, start = F.col("core_text"), F.greatest(F.lit(0), F.coalesce("start_offset", F.lit(0)))
    end = F.greatest(start, F.coalesce(F.nullif(F.col("end_offset"), F.lit(0)), F.length(core)))
    return F.coalesce(F.nullif(F.substring(core, start + 1, end - start), F.lit("")), F.col("embedding_text_preview"))


def match_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = parents(spark, sf_dir).filter("workspace_id is not null").select("parent_id", F.col("workspace_id").alias("scope"), "core_text")
    return children(spark, sf_dir).join(owner, "parent_id").select("scope", "parent_id", "child_id", child_text().alias("text"), "vector", "vector_model", "child_no")


def match_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every child whose number is divisible by 20, asked within its workspace."""
    rows = match_children(spark, sf_dir).filter("child_no % 20 = 0 and text is not null")
    return rows.select(F.col("child_no").alias("query_id"), "scope", "text", "vector", "vector_model")


# SQL

STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"
RUNS = r"'[\x{3400}-\x{9fff}]+'"


def sql_norm(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '\\s+', ' ', 'g'))"


def sql_tokens(c: str) -> str:
    words = f"regexp_extract_all({sql_norm(c)}, '[a-z][\\w-]*|\\d+(?:\\.\\d+)?')"
    grams = "flatten(list_transform([2, 3, 4], lambda w: list_transform(range(1, length(r) - w + 2), lambda i: substring(r, i, w))))"
    return f"list_distinct(list_concat({words}, flatten(list_transform(regexp_extract_all({sql_norm(c)}, {RUNS}), lambda r: list_concat([r], {grams})))))"


def sql_informative(tokens: str) -> str:
    return f"list_filter({tokens}, lambda t: NOT list_contains({STOP}, t) AND NOT regexp_matches(t, '^[a-z]$'))"


def sql_strong(t: str) -> str:
    return rf"(regexp_matches({t}, '^[\x{{3400}}-\x{{9fff}}]+$') AND length({t}) >= 2 OR length({t}) >= 3 OR regexp_matches({t}, '^\d{{2,}}$'))"


def sql_estimate(c: str) -> str:
    runs = rf"list_sum(list_transform(regexp_extract_all(coalesce({c}, ''), '[\x00-\x7F]+'), lambda r: (length(r) + 3) // 4))"
    return rf"CAST(length(regexp_replace(coalesce({c}, ''), '[\x00-\x7F]', '', 'g')) + coalesce({runs}, 0) AS BIGINT)"


def sql_cosine(a: str, b: str) -> str:
    dot = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
    norm = f"sqrt({dot(a, a)}) * sqrt({dot(b, b)})"
    return f"CASE WHEN len({a}) = len({b}) AND len({a}) > 0 AND {norm} > 0 AND {norm} < 'infinity'::DOUBLE THEN {dot(a, b)} / ({norm}) ELSE 0.0 END"


SQL_PARENTS = "SELECT parent_no, " + ", ".join(f"max({c}) AS {c}" for c in PARENT_COLUMNS) + " FROM parent_chunks GROUP BY parent_no"
SQL_CHILDREN = """SELECT child_no, max(child_id) AS child_id, max(parent_id) AS parent_id, max(start_offset) AS start_offset, max(end_offset) AS end_offset, max(embedding_text_preview) AS preview, arg_max(vector, vector) AS vector, max(vector_model) AS vector_model
  FROM child_spans GROUP BY child_no"""


def sql_slice(core: str) -> str:
    """The child's slice of the parent's text; the preview only where that is empty."""
    a = "greatest(0, coalesce(start_offset, 0))"
    return f"coalesce(nullif(substring({core}, {a} + 1, greatest({a}, coalesce(nullif(end_offset, 0), length({core}))) - {a}), ''), preview)"


SQL_SCORE = "CASE WHEN phrase THEN 1.0 WHEN coverage >= 0.75 THEN 0.85 WHEN n_strong >= 2 THEN 0.80 WHEN coverage >= 0.5 THEN 0.70 WHEN coverage >= 0.25 THEN 0.35 ELSE 0.0 END"

#: Messages as flat records with their text, the first ingested of each number.
SQL_RECORDS = """rec AS (
  SELECT session_id, seq, CASE event_type WHEN 'user/message' THEN 'user' WHEN 'assistant/message' THEN 'assistant' ELSE 'tool' END AS role,
    source.kind AS source_kind, source.purpose AS purpose, tool_name, coalesce(CASE WHEN ltrim(content) LIKE '[%' AND json_valid(content) THEN
      array_to_string(list_filter(list_transform(CAST(content AS JSON[]), lambda b: coalesce(b->>'$.text', b->>'$.content')), lambda x: x IS NOT NULL), chr(10)) ELSE content END, '') AS text
  FROM session_events WHERE event_type IN ('user/message', 'assistant/message', 'tool/result') AND session_id IS NOT NULL AND seq IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY session_id, seq ORDER BY ingested_at NULLS LAST) = 1)"""
