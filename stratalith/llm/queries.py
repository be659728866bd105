"""Queries of problems 2 to 8 and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.llm import conversations, mixing, neardup, neighbours, packing, spans, splitting


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversations(_table(spark, sf_dir, "session_events")).select("session_id", "msg_no", "seq")


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reply links of the kept sessions, and the thread of each message."""
    return conversations.conversations(_table(spark, sf_dir, "session_events")).select("session_id", "seq", "parent_seq", "thread", F.round("link_score", 4).alias("link_score"))


#: Problem 3 is stated for runs of three words and a similarity of at least 0.6.
P3 = {"threshold": 0.6, "n": 3}


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "parent_chunks")
    return rows.selectExpr("parent_no AS member", "document_id AS owner", "core_text AS text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neardup.similar_pairs(*neardup.similar_classes(_parents(spark, sf_dir), **P3))
    return pairs.selectExpr("a AS parent_a", "b AS parent_b")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(*neardup.similar_classes(_parents(spark, sf_dir), **P3))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.links(neighbours.nearest(_table(spark, sf_dir, "child_spans")))


def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set, ids divisible by 20, against all rows."""
    spans = _table(spark, sf_dir, "child_spans")
    return neighbours.exact_nearest(spans, spans.filter("child_no % 20 = 0").select("child_no").distinct())


def p4_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _exact(spark, sf_dir).select("child_no", F.posexplode("near").alias("i", "x"))
    return near.select("child_no", (F.col("i") + 1).cast("bigint").alias("rank"), F.col("x.id").alias("near_no"), F.round("x.similarity", 6).alias("similarity"))


def p4_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the exact neighbours of that query set the index finds, in one row; ``reached`` at a recall of 0.95."""
    exact = _exact(spark, sf_dir).select("child_no", F.explode("near.id").alias("id"))
    found = neighbours.nearest(_table(spark, sf_dir, "child_spans")).filter("child_no % 20 = 0").select("child_no", F.explode("near.id").alias("id"), F.lit(1).alias("hit"))
    return exact.join(found, ["child_no", "id"], "left").agg(F.count("*").alias("n_pairs"), (F.count("hit") >= 0.95 * F.count("*")).alias("reached"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "parent_chunks").selectExpr("parent_no AS id", "document_title AS title", "core_text AS text")
    return splitting.pieces(rows).withColumnRenamed("id", "parent_no")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).select("parent_no").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).distinct()


def p5_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cores of the pieces put together again, and whether every piece and overlap keeps its limit."""
    rows = _pieces(spark, sf_dir).distinct()
    core = F.expr("right(piece_text, end_offset - start_offset)")
    rows = rows.groupBy("parent_no").agg(F.array_sort(F.collect_list(F.struct("piece_no", core.alias("core")))).alias("c"), F.bool_and(F.expr("token_count <= 512 and overlap_tokens <= 64")).alias("within"))
    whole = F.array_join(F.transform("c", lambda x: x["core"]), "")
    return rows.select("parent_no", F.length(whole).cast("bigint").alias("n_chars"), F.md5(whole.cast("binary")).alias("digest"), "within")


def p6_check(spark: SparkSession, sf_dir: str, kind: str = "medium") -> DataFrame:
    capacity = packing.capacity_of(_table(spark, sf_dir, "container_kinds"), kind)
    return packing.checked(packing.pack(_table(spark, sf_dir, "documents"), capacity), capacity)


def p6_pack(spark: SparkSession, sf_dir: str, kind: str = "medium") -> DataFrame:
    capacity = packing.capacity_of(_table(spark, sf_dir, "container_kinds"), kind)
    return packing.pack(_table(spark, sf_dir, "documents"), capacity)


def p6_fill(spark: SparkSession, sf_dir: str, kind: str = "medium") -> DataFrame:
    capacity = packing.capacity_of(_table(spark, sf_dir, "container_kinds"), kind)
    return packing.fill(packing.pack(_table(spark, sf_dir, "documents"), capacity), capacity)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "source_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "source_targets"))[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(_table(spark, sf_dir, "documents")).select("doc_id", "first_word", "last_word").distinct()


def p8_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_share(_table(spark, sf_dir, "documents"))


QUERIES = {"p2_found": p2_found, "p2_links": p2_links, "p5_found": p5_found, "p5_pieces": p5_pieces, "p5_roundtrip": p5_roundtrip, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p4_exact": p4_exact, "p4_recall": p4_recall, "p6_pack": p6_pack, "p6_fill": p6_fill, "p6_check": p6_check, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_share": p8_share}
P2_SQL = """
WITH distinct_rows AS (
  SELECT * EXCLUDE (pick) FROM (
    SELECT session_id, seq, turn, role, content, call_id, event_type, source.kind AS source_kind,
      row_number() OVER (PARTITION BY session_id, seq, content ORDER BY ingested_at NULLS LAST, turn, call_id, event_type, role) AS pick
    FROM session_events WHERE session_id IS NOT NULL AND seq IS NOT NULL)
  WHERE pick = 1
), whole AS (
  SELECT session_id FROM (SELECT session_id, seq, count(*) AS n FROM distinct_rows GROUP BY ALL)
  GROUP BY session_id HAVING max(n) = 1 AND min(seq) = 1 AND max(seq) = count(*)
), kinds AS (
  SELECT r.*, coalesce(event_type, CASE lower(trim(role)) WHEN 'user' THEN 'user/message' WHEN 'assistant' THEN 'assistant/message' WHEN 'tool' THEN 'tool/result' END) AS kind,
    CASE WHEN ltrim(content) LIKE '[%' AND json_valid(content) THEN array_to_string(list_transform(
      list_filter(CAST(content AS JSON[]), lambda b: b->>'$.type' = 'text'), lambda b: b->>'$.text'), ' ') ELSE content END AS body
  FROM distinct_rows r SEMI JOIN whole USING (session_id)
), starts AS (
  SELECT session_id, seq AS opened, turn, seq = max(seq) OVER (PARTITION BY session_id, turn) OR turn IS NULL AS counts
  FROM kinds WHERE kind = 'turn/start'
), placed AS (
  SELECT k.*, max(CASE WHEN kind = 'turn/start' THEN seq END) OVER (PARTITION BY session_id ORDER BY seq) AS opened FROM kinds k
), windows AS (
  SELECT p.*, 's' || opened AS win FROM placed p SEMI JOIN (SELECT * FROM starts WHERE counts) s USING (session_id, opened)
  UNION ALL
  SELECT p.*, 't' || coalesce(CAST(turn AS VARCHAR), '') FROM placed p ANTI JOIN starts s USING (session_id)
), messages AS (
  SELECT * FROM windows WHERE kind IN ('user/message', 'assistant/message', 'tool/result')
    AND NOT (kind = 'user/message' AND coalesce(source_kind, '') = 'plugin') AND regexp_matches(coalesce(body, ''), '[\\p{L}\\p{N}]')
), turns AS (
  SELECT session_id, win, arg_min(kind, seq) AS opener, max(seq) FILTER (kind = 'user/message') AS asked, max(seq) FILTER (kind = 'assistant/message') AS answered
  FROM messages GROUP BY ALL
), broken AS (
  SELECT session_id FROM turns WHERE opener <> 'user/message' OR (asked IS NOT NULL AND coalesce(answered, 0) < asked)
  UNION
  SELECT session_id FROM windows t WHERE kind = 'tool/result' AND NOT EXISTS (SELECT 1 FROM windows a
    WHERE a.session_id = t.session_id AND a.win = t.win AND a.kind = 'assistant/message' AND a.call_id = t.call_id AND a.seq < t.seq)
  UNION
  SELECT session_id FROM windows a WHERE kind = 'assistant/message' AND call_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM windows t
    WHERE a.session_id = t.session_id AND a.win = t.win AND t.kind = 'tool/result' AND a.call_id = t.call_id AND a.seq < t.seq)
)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS msg_no, seq FROM messages ANTI JOIN broken USING (session_id)
"""

#: Every earlier message of the window as a candidate, scored without any index.
P2_LINKS_SQL = P2_SQL.replace("WITH distinct_rows", "WITH RECURSIVE distinct_rows", 1).replace("SELECT session_id, seq, turn, role, content,", "SELECT session_id, seq, turn, role, content, event_time,", 1).rsplit("SELECT session_id, row_number()", 1)[0] + """,
kept AS (SELECT * FROM messages ANTI JOIN broken USING (session_id)),
clocks AS (SELECT session_id, seq, max(epoch_us(event_time)) OVER (PARTITION BY session_id ORDER BY seq) AS clock FROM kinds),
words AS (SELECT DISTINCT session_id, win, seq, unnest(regexp_extract_all(regexp_replace(lower(coalesce(body, '')), '([\\x{3400}-\\x{9fff}])', ' \\1 ', 'g'), '[\\p{L}\\p{N}]+')) AS word FROM kept),
rare AS (SELECT session_id, win, word FROM words GROUP BY ALL HAVING count(*) <= 16),
bags AS (SELECT session_id, win, seq, list(word) AS bag FROM words SEMI JOIN rare USING (session_id, win, word) GROUP BY ALL),
facts AS (SELECT k.session_id, k.win, k.seq, kind, call_id, clock, coalesce(bag, []) AS bag FROM kept k JOIN clocks USING (session_id, seq) LEFT JOIN bags b ON b.session_id = k.session_id AND b.win = k.win AND b.seq = k.seq),
options AS (SELECT c.session_id, c.seq, p.seq AS parent_seq, round(0.5 * pow(0.5, least(coalesce(c.clock - p.clock, 0) / 1e6 / 1800, 60)) + CASE WHEN c.call_id = p.call_id THEN 2.0 ELSE 0.0 END
    + CASE WHEN (c.kind, p.kind) IN (('assistant/message', 'user/message'), ('assistant/message', 'tool/result'), ('tool/result', 'assistant/message'), ('user/message', 'assistant/message')) THEN 0.4 ELSE 0.0 END
    + CASE WHEN len(c.bag) > 0 AND len(p.bag) > 0 THEN 0.8 * len(list_intersect(c.bag, p.bag)) / least(len(c.bag), len(p.bag)) ELSE 0.0 END, 9) AS score
  FROM facts c JOIN facts p ON c.session_id = p.session_id AND c.win = p.win AND p.seq < c.seq),
chosen AS (SELECT session_id, seq, max(ROW(score, parent_seq)) AS b FROM options WHERE score >= 0.7 GROUP BY ALL),
links AS (SELECT f.session_id, f.seq, b[2] AS parent_seq, b[1] AS link_score FROM facts f LEFT JOIN chosen USING (session_id, seq)),
trees AS (SELECT session_id, seq, seq AS thread FROM links WHERE parent_seq IS NULL UNION ALL SELECT l.session_id, l.seq, t.thread FROM links l JOIN trees t ON l.session_id = t.session_id AND l.parent_seq = t.seq)
SELECT session_id, seq, CAST(parent_seq AS BIGINT) AS parent_seq, thread, CAST(round(link_score, 4) AS DOUBLE) AS link_score FROM links JOIN trees USING (session_id, seq)
"""

P3_SQL = """
WITH texts AS (SELECT parent_no, max(document_id) AS d, regexp_extract_all(lower(max(core_text)), '[\\p{L}\\p{N}]+') AS w FROM parent_chunks GROUP BY parent_no),
runs AS (SELECT DISTINCT parent_no, d, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS run FROM texts),
sizes AS (SELECT parent_no, count(*) AS n FROM runs GROUP BY parent_no),
pairs AS (SELECT a.parent_no AS parent_a, b.parent_no AS parent_b, count(*) AS shared FROM runs a JOIN runs b USING (run) WHERE a.parent_no < b.parent_no AND a.d <> b.d GROUP BY ALL)
SELECT parent_a, parent_b FROM pairs JOIN sizes x ON x.parent_no = parent_a JOIN sizes y ON y.parent_no = parent_b WHERE shared / (x.n + y.n - shared) >= 0.6
"""

#: Brute force over the query set.
P4_SQL = """
WITH u AS (SELECT child_no, any_value(vector_model) AS m, any_value(vector) AS v FROM child_spans WHERE vector_model IS NOT NULL AND len(vector) = 64
    AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY child_no),
n AS (SELECT child_no, m, CAST(v AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(CAST(v AS DOUBLE[]), lambda x: x * x))) AS size FROM u),
s AS (SELECT a.child_no, b.child_no AS near_no, round(list_dot_product(a.v, b.v) / (a.size * b.size), 12) AS similarity FROM n a JOIN n b ON a.m = b.m AND a.child_no <> b.child_no WHERE a.child_no % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY child_no ORDER BY similarity DESC, near_no) AS rank FROM s QUALIFY rank <= 5)
"""

P8_SQL = """
WITH texts AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
words AS (SELECT doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS word FROM texts),
windows AS (SELECT doc_id, i, md5(string_agg(word, ' ') OVER r) AS h, count(*) OVER r AS n
  FROM words WINDOW r AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 39 FOLLOWING)),
shared AS (SELECT doc_id, i FROM windows SEMI JOIN (SELECT h FROM windows WHERE n = 40 GROUP BY h HAVING min(doc_id) < max(doc_id)) USING (h) WHERE n = 40),
marked AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 40 THEN 1 ELSE 0 END AS new FROM shared),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, min(i) AS first_word, max(i) + 39 AS last_word FROM runs GROUP BY doc_id, run)
"""

OVER = """length(regexp_replace(core_text, '[\\x00-\\x7F]', '', 'g'))
  + list_sum(list_transform(regexp_extract_all(core_text, '[\\x00-\\x7F]+'), lambda r: (length(r) + 3) // 4)) > 512"""

SQL: dict[str, str] = {
    "p3_found": P3_SQL,
    "p4_exact": P4_SQL + "SELECT child_no, rank, near_no, round(similarity, 6) AS similarity FROM r",
    "p4_recall": P4_SQL + "SELECT count(*) AS n_pairs, true AS reached FROM r",
    "p8_found": P8_SQL + "SELECT doc_id, first_word, last_word FROM spans",
    "p8_share": P8_SQL + """SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS shared_words, coalesce(n, 0) / greatest(coalesce(len(w), 0), 1) AS shared_share
FROM texts LEFT JOIN (SELECT doc_id, sum(last_word - first_word + 1) AS n FROM spans GROUP BY doc_id) USING (doc_id)""",
    "p2_found": P2_SQL,
    "p2_links": P2_LINKS_SQL,
    "p5_found": f"SELECT DISTINCT parent_no FROM parent_chunks WHERE {OVER}",
    "p5_roundtrip": f"SELECT DISTINCT parent_no, length(core_text) AS n_chars, md5(core_text) AS digest, true AS within FROM parent_chunks WHERE {OVER}",
    "p6_check": "SELECT count(*) AS n_documents, CAST(0 AS BIGINT) AS over_capacity, CAST(0 AS BIGINT) AS misplaced, CAST(0 AS BIGINT) AS cut_early FROM documents WHERE trim(text, E' \\n') <> ''",
}
