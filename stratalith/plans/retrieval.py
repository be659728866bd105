"""Queries over texts, vectors and the retrieval stages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalith import storage
from stratalith.functions import text, vector
from stratalith.operators import chunker, match, render, segment
from stratalith.plans import tables as t


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


def informative_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = text.lexical_tokens(F.col("core_text"))
    rows = t.parents(spark, d).select("parent_no", tokens.alias("t"))
    return rows.select("parent_no", F.size("t").cast("bigint").alias("n_tokens"), F.size(text.informative(F.col("t"))).cast("bigint").alias("n_informative"))


def feature_hash_slots(spark: SparkSession, d: str) -> DataFrame:
    rows = t.parents(spark, d).select("parent_no", F.explode(vector.hash_slots(text.encoder_tokens(F.col("core_text")))).alias("h"))
    return rows.groupBy("parent_no", F.col("h.slot").cast("bigint").alias("slot")).agg(F.sum("h.sign").cast("bigint").alias("weight"))


def feature_hash_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The title's vector of each parent against that of the next one."""
    rows = t.parents(spark, d).filter("document_title is not null").select("parent_no", vector.feature_hash(F.col("document_title")).alias("v"))
    span = F.lit(1024)  # numbers of one range; the next parent of a range's last is the first of the next range that has one
    rows = storage.materialize(rows.withColumn("range", F.floor(F.col("parent_no") / span)), "vectors")
    firsts = rows.groupBy("range").agg(F.min("parent_no").alias("first"))
    after = firsts.select("range", F.lead("first").over(Window.orderBy("range")).alias("beyond"))  # one small row per range
    within = F.lead("parent_no").over(Window.partitionBy("range").orderBy("parent_no"))
    pairs = rows.withColumn("within", within).join(after, "range").select("parent_no", "v", F.coalesce("within", "beyond").alias("next_no")).filter("next_no is not null")
    pairs = pairs.join(rows.select(F.col("parent_no").alias("next_no"), F.col("v").alias("w")), "next_no")
    return pairs.select("parent_no", "next_no", F.round(vector.cosine(F.col("v"), F.col("w")), 6).alias("cosine"))


def child_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Each child against the next one of its parent."""
    rows = t.children(spark, d)
    after = F.lead(F.struct("child_no", "vector", "vector_model")).over(t_window())
    rows = rows.withColumn("n", after).filter("n is not null")
    score = vector.child_score(F.col("vector"), F.col("vector_model"), F.col("n.vector"), F.col("n.vector_model"))
    return rows.select("child_no", F.col("n.child_no").alias("next_no"), F.round(F.coalesce(score, F.lit(0.0)), 6).alias("cosine"))


def t_window():
    return Window.partitionBy("parent_id").orderBy("child_no")


def query_decompose(spark: SparkSession, d: str) -> DataFrame:
    rows = segment.records(t.table(spark, d, "session_events")).filter("role = 'user'")
    rows = rows.select("session_id", "seq", F.size(text.clauses(F.col("text"))).alias("n_clauses"), text.decompose(F.col("text")).alias("p"))
    return rows.select("session_id", "seq", "n_clauses", "p.subqueries", F.size("p.rejected").alias("n_rejected"))


def _recall(spark: SparkSession, d: str, k: int | None) -> DataFrame:
    rows = t.parents(spark, d)
    queries = rows.filter("parent_no % 20 = 0 and document_title is not null").select(F.col("parent_no").alias("query_id"), F.col("document_title").alias("text"))
    return match.lexical_recall(queries, rows.select(F.col("parent_no").alias("candidate_id"), F.col("core_text").alias("text")), k=k)


def lexical_score(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d, None).select("query_id", "candidate_id", "matched", "n_strong", F.round("coverage", 6).alias("coverage"), "score")


def lexical_recall_topk(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d, 8).select("query_id", "candidate_id", F.col("rank").cast("bigint").alias("rank"), "score")


RECALL_SQL = f"""
WITH p AS ({t.SQL_PARENTS}),
q AS (SELECT parent_no AS query_id, {t.sql_norm("document_title")} AS qn, {t.sql_informative(t.sql_tokens("document_title"))} AS tokens FROM p WHERE parent_no % 20 = 0 AND document_title IS NOT NULL),
c AS (SELECT parent_no AS candidate_id, {t.sql_norm("core_text")} AS cn, unnest({t.sql_tokens("core_text")}) AS token FROM p),
hits AS (SELECT query_id, candidate_id, count(*) AS matched, count(*) FILTER ({t.sql_strong("token")}) AS n_strong, any_value(n) AS n,
    any_value(length(qn) >= 3 AND contains(cn, qn)) AS phrase
  FROM (SELECT query_id, qn, len(tokens) AS n, unnest(tokens) AS token FROM q) JOIN c USING (token) GROUP BY ALL),
scored AS (SELECT *, {t.SQL_SCORE} AS score FROM (SELECT *, matched / n AS coverage FROM hits))
"""


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))
    found = match.dense_top(rows.filter("row_id % 20 = 0").withColumnRenamed("row_id", "query_id"), rows, k=8)
    return found.select("query_id", "row_id", F.round("cosine", 6).alias("cosine"))


def _stages(spark: SparkSession, d: str, split: bool) -> match.Retrieval:
    return match.Retrieval(t.match_queries(spark, d), t.match_children(spark, d), t.match_parents(spark, d), split)


def hybrid_admission(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1
    return _stages(spark, d, False).admitted.select("query_id", "parent_id", "child_id", place.cast("bigint").alias("rank"), F.round("score", 6).alias("score"), F.round("strength", 6).alias("strength"), "tier", "reason")


def lexical_guarantee(spark: SparkSession, d: str) -> DataFrame:
    return _stages(spark, d, False).guaranteed.select("query_id", "parent_id", "child_id", F.round("coverage", 6).alias("coverage"), F.round("strength", 6).alias("strength"), "covers")


def child_union_top32(spark: SparkSession, d: str) -> DataFrame:
    return _stages(spark, d, False).hits.select("query_id", "parent_id", "child_id", F.round("priority", 6).alias("priority"))


def parent_rank_top16(spark: SparkSession, d: str) -> DataFrame:
    rows = _stages(spark, d, False).parents
    return rows.select("query_id", "parent_id", F.col("parent_rank").cast("bigint").alias("rank"), F.round("best_dense", 6).alias("best_dense"), F.round("top_avg", 6).alias("top_avg"), F.col("anchors").cast("bigint").alias("anchors"), "qualified")


def coverage_argmax(spark: SparkSession, d: str) -> DataFrame:
    """How each parent covers a query best, among the hits that cover it."""
    rows = match.coverage(_stages(spark, d, False).hits)
    return rows.select("query_id", "parent_id", "sub", "c.tier", F.round("c.strength", 6).alias("strength"), F.round("c.score", 6).alias("score"), "c.reason")


def parent_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """The measures of every parent that has a hit, before any limit."""
    rows = match.measured(_stages(spark, d, False).hits)
    return rows.select("query_id", "parent_id", F.round("best_dense", 6).alias("best_dense"), F.round(F.col("top_sum") / F.col("top_n"), 6).alias("top_avg"), F.col("lexical").cast("double").alias("lexical"), F.col("anchors").cast("bigint").alias("anchors"), F.size("tokens").cast("bigint").alias("n_tokens"), "reasons")


STAGES_SQL = f"""
WITH p AS ({t.SQL_PARENTS}), ch AS ({t.SQL_CHILDREN}),
c AS (SELECT scope, parent_id, child_id, child_no, text, vector, vector_model, eligible, updated_at, {t.sql_norm("text")} AS cn, {t.sql_tokens("text")} AS ct FROM (
  SELECT *, workspace_id AS scope, {t.sql_slice("core_text")} AS text, trim(core_text) <> '' AND coalesce(evidence_quality, 0) >= 0.8 AND coalesce(temporal_current, true) AS eligible
  FROM ch JOIN (SELECT parent_id, workspace_id, core_text, evidence_quality, temporal_current, updated_at FROM p WHERE workspace_id IS NOT NULL) USING (parent_id))),
q AS (SELECT child_no AS query_id, scope, cn AS qn, {t.sql_informative("ct")} AS qt, vector AS qv, vector_model AS qm FROM c WHERE child_no % 20 = 0 AND text IS NOT NULL AND cn <> ''),
pairs AS (SELECT query_id, parent_id, child_id, eligible, updated_at, len(qt) AS n, list_intersect(qt, ct) AS matched, length(qn) >= 3 AND contains(cn, qn) AS phrase,
    coalesce(CASE WHEN qm = vector_model THEN round(greatest(0.0, {t.sql_cosine("qv", "vector")}), 12) ELSE 0.0 END, 0.0) AS dense FROM q JOIN c USING (scope)),
measured AS (SELECT *, CASE WHEN n > 0 THEN len(matched) / n ELSE 0.0 END AS coverage, len(list_filter(matched, lambda m: {t.sql_strong("m")})) AS n_strong FROM pairs),
lexed AS (SELECT *, {t.SQL_SCORE} AS lexical, phrase OR n_strong >= 1 AS anchor FROM measured),
scored AS (SELECT *, greatest(lexical, dense) AS score FROM lexed WHERE greatest(lexical, dense) > 0),
ordered AS (SELECT *, row_number() OVER w - 1 AS rank, first_value(score) OVER w AS top, coalesce(nth_value(score, 2) OVER (PARTITION BY query_id ORDER BY score DESC, dense DESC, child_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.0) AS second
  FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, dense DESC, child_id)),
margins AS (SELECT *, CASE WHEN rank = 0 THEN greatest(0.0, score - second) ELSE 0.0 END AS margin FROM ordered),
strengths AS (SELECT *, phrase OR coverage >= 0.35 OR (rank = 0 AND dense >= 0.75 AND margin >= 0.025) AS strong FROM margins),
ranked AS (SELECT *, CASE WHEN phrase THEN 1.0 WHEN coverage >= 0.35 THEN greatest(0.55, coverage) WHEN strong THEN least(0.90, 0.60 + 4 * margin) WHEN rank = 0 THEN 0.20 ELSE 0.0 END AS strength FROM strengths),
admitted AS (SELECT *, CASE WHEN anchor THEN 'lexical-anchor' WHEN score >= greatest(0.0, top - 0.20) THEN 'relative-window' ELSE 'top1-recall-guard' END AS reason, CASE WHEN strong THEN 'strong' ELSE 'weak-top1-fallback' END AS tier
  FROM ranked WHERE anchor OR score >= greatest(0.0, top - 0.20) OR (rank = 0 AND eligible) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 8),
per_parent AS (SELECT * FROM ranked r WHERE anchor AND NOT EXISTS (SELECT 1 FROM admitted a WHERE a.query_id = r.query_id AND a.parent_id = r.parent_id)
  QUALIFY row_number() OVER (PARTITION BY query_id, parent_id ORDER BY phrase DESC, coverage DESC, n_strong DESC, dense DESC, rank) = 1),
guaranteed AS (SELECT * REPLACE (greatest(0.50, coverage) AS strength), coverage >= 0.20 OR n_strong >= 2 AS covers FROM per_parent
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY phrase DESC, coverage DESC, n_strong DESC, dense DESC, rank) <= 4),
everything AS (SELECT query_id, parent_id, child_id, rank, score, strength, coverage, dense, lexical, anchor, eligible, updated_at, matched, tier, reason, strong OR rank = 0 AS covers FROM admitted
  UNION ALL SELECT query_id, parent_id, child_id, rank, score, strength, coverage, dense, lexical, anchor, eligible, updated_at, matched, 'strong', 'lexical-guarantee', covers FROM guaranteed),
hits AS (SELECT *, score + 0.15 * strength + 0.20 * coverage AS priority FROM everything
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, rank, parent_id, child_id) <= 32),
parents AS (SELECT query_id, parent_id, max(dense) AS best_dense, list_sum(list_sort(list(dense), 'DESC')[1:2]) / least(count(*), 2) AS top_avg, max(lexical) AS lexical, count(*) FILTER (anchor) AS anchors, any_value(eligible) AS qualified, any_value(updated_at) AS updated_at
  FROM hits GROUP BY query_id, parent_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY anchors DESC, lexical DESC, top_avg DESC, best_dense DESC, greatest(best_dense, lexical) DESC, updated_at DESC NULLS LAST, parent_id) AS rank FROM parents)
"""


def retrieve(spark: SparkSession, d: str) -> DataFrame:
    return _stages(spark, d, True).result


def coverage_select(spark: SparkSession, d: str) -> DataFrame:
    return _stages(spark, d, True).picks.select("query_id", "pick", "parent_id", F.round("value", 6).alias("value"))


def bank_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Parents of low quality play the bank: they are asked only where the others don't settle a query."""
    parents, children = t.match_parents(spark, d), t.match_children(spark, d)
    first, rest = parents.filter("eligible"), parents.filter("not eligible").withColumn("eligible", F.lit(True))
    side = lambda p: (children.join(p.select("parent_id"), "parent_id", "left_semi").drop("child_no"), p)
    return match.with_fallback(t.match_queries(spark, d), side(first), side(rest)).select("query_id", "stage", "sufficient", "n_parents")


def catalog_entries(spark: SparkSession, d: str) -> DataFrame:
    """Catalogs of all queries, rendered and read back."""
    stages = _stages(spark, d, True)
    rows = stages.picks.join(stages.parents.select("query_id", "parent_id", "view"), ["query_id", "parent_id"])
    rows = rows.withColumns({"layer": F.lit("sensory"), "first_seq": F.lit(1), "last_seq": F.lit(9)})
    return render.parse_catalog(render.catalog(rows)).select("query_id", "name", "layer", "seq")


def evidence_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = t.parents(spark, d)
    reason = match.eligibility(F.col("core_text"), F.when(F.col("session_id").isNotNull(), 1), F.col("evidence_quality"), F.lit(False), F.col("temporal_current"), F.lit(None).cast("string"))
    return rows.select("parent_no", reason.alias("reason"))


def source_validation(spark: SparkSession, d: str) -> DataFrame:
    events, rows = t.table(spark, d, "session_events"), t.parents(spark, d)
    sources = segment.records(events).select("session_id", "seq", "text")
    refs = rows.select("parent_id", "session_id").join(sources.select("session_id", "seq"), "session_id")
    return match.validated(refs, sources, rows.select("parent_id", F.col("core_text").alias("view"))).select("parent_id", "n_refs", "n_found", "reason")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "documents")
    none = F.lit(None).cast("string")
    return rows.select(F.col("doc_id").cast("string").alias("source_id"), none.alias("title"), "text", none.alias("format"), none.alias("language"))


def chunk_parents(spark: SparkSession, d: str) -> DataFrame:
    return chunker.chunk_table(_documents(spark, d)).select("source_id", "parent_id", "document_title", "format", "token_count", F.size("children").alias("n_children"))


def chunk_children(spark: SparkSession, d: str) -> DataFrame:
    return chunker.children(chunker.chunk_table(_documents(spark, d))).select("parent_id", "child_id", "start_offset", "end_offset", "token_count", "embedding_text_preview")


FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(tok, ''), lambda ch: unicode(ch)::BIGINT)), lambda h, u: (xor(h, u) * 16777619) & 4294967295)"

QUERIES = {
    f.__name__: f
    for f in (
        token_estimate, informative_tokens, feature_hash_slots, child_cosine, query_decompose, lexical_score, lexical_recall_topk, dense_topk, hybrid_admission, lexical_guarantee,
        child_union_top32, parent_rank_top16, coverage_argmax, parent_aggregate, feature_hash_cosine, retrieve, coverage_select, bank_fallback, catalog_entries, evidence_gate, source_validation, chunk_parents, chunk_children,
    )
}

SQL = {
    "token_estimate": f"SELECT doc_id, {t.sql_estimate('text')} AS tokens FROM documents",
    "informative_tokens": f"SELECT parent_no, len(tokens) AS n_tokens, len({t.sql_informative('tokens')}) AS n_informative FROM (SELECT parent_no, {t.sql_tokens('core_text')} AS tokens FROM ({t.SQL_PARENTS}))",
    "feature_hash_slots": rf"""
SELECT parent_no, h % 64 AS slot, CAST(sum(CASE WHEN h & 2147483648 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS weight FROM (
  SELECT parent_no, {FNV} AS h FROM (
    SELECT parent_no, unnest(list_concat(regexp_extract_all(lower(core_text), '[a-z][\w-]*|\d+(?:\.\d+)?'),
      flatten(list_transform(regexp_extract_all(core_text, {t.RUNS}), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) END)))) AS tok
    FROM ({t.SQL_PARENTS}) WHERE core_text IS NOT NULL)) GROUP BY ALL""",
    "child_cosine": f"""
WITH ch AS ({t.SQL_CHILDREN}), n AS (SELECT *, lead(child_no) OVER w AS next_no, lead(vector) OVER w AS nv, lead(vector_model) OVER w AS nm FROM ch WINDOW w AS (PARTITION BY parent_id ORDER BY child_no))
SELECT child_no, next_no, round(coalesce(CASE WHEN vector_model = nm THEN greatest(0.0, {t.sql_cosine("vector", "nv")}) ELSE 0.0 END, 0.0), 6) AS cosine FROM n WHERE next_no IS NOT NULL""",
    "lexical_score": RECALL_SQL + "SELECT query_id, candidate_id, matched, n_strong, round(coverage, 6) AS coverage, score FROM scored WHERE score > 0",
    "lexical_recall_topk": RECALL_SQL + "SELECT query_id, candidate_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coverage DESC, candidate_id) AS rank, score FROM scored WHERE score > 0 QUALIFY rank <= 8",
    "dense_topk": f"""
SELECT q.vec_id AS query_id, r.vec_id AS row_id, round({t.sql_cosine("q.embedding", "r.embedding")}, 6) AS cosine FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {t.sql_cosine("q.embedding", "r.embedding")} DESC, r.vec_id) <= 8""",
    "hybrid_admission": STAGES_SQL + "SELECT query_id, parent_id, child_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS rank, round(score, 6) AS score, round(strength, 6) AS strength, tier, reason FROM admitted",
    "lexical_guarantee": STAGES_SQL + "SELECT query_id, parent_id, child_id, round(coverage, 6) AS coverage, round(strength, 6) AS strength, covers FROM guaranteed",
    "child_union_top32": STAGES_SQL + "SELECT query_id, parent_id, child_id, round(priority, 6) AS priority FROM hits",
    "parent_rank_top16": STAGES_SQL + "SELECT query_id, parent_id, rank, round(best_dense, 6) AS best_dense, round(top_avg, 6) AS top_avg, anchors, qualified FROM placed WHERE rank <= 16",
    "coverage_argmax": STAGES_SQL + """SELECT query_id, parent_id, 0 AS sub, tier, round(strength, 6) AS strength, round(score, 6) AS score, reason FROM hits WHERE covers
  QUALIFY row_number() OVER (PARTITION BY query_id, parent_id ORDER BY strength DESC, score DESC, rank) = 1""",
    "parent_aggregate": STAGES_SQL + """SELECT query_id, parent_id, round(max(dense), 6) AS best_dense, round(list_sum(list_sort(list(dense), 'DESC')[1:2]) / least(count(*), 2), 6) AS top_avg, CAST(max(lexical) AS DOUBLE) AS lexical, count(*) FILTER (anchor) AS anchors,
  len(list_distinct(flatten(list(matched)))) AS n_tokens, list_sort(list_distinct(list(reason))) AS reasons FROM hits GROUP BY query_id, parent_id""",
    "feature_hash_cosine": f"""WITH w AS (SELECT parent_no, h % 64 AS slot, sum(CASE WHEN h & 2147483648 = 0 THEN 1 ELSE -1 END) AS weight FROM (SELECT parent_no, {FNV} AS h FROM (
    SELECT parent_no, unnest(list_concat(regexp_extract_all(lower(document_title), '[a-z][\\w-]*|\\d+(?:\\.\\d+)?'), flatten(list_transform(regexp_extract_all(document_title, {t.RUNS}), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) END)))) AS tok
    FROM ({t.SQL_PARENTS}) WHERE document_title IS NOT NULL)) GROUP BY ALL),
u AS (SELECT parent_no, slot, floor(weight / sqrt(sum(weight * weight) OVER (PARTITION BY parent_no)) * 1e6 + 0.5) / 1e6 AS v FROM w),
sizes AS (SELECT parent_no, sqrt(sum(v * v)) AS size FROM u GROUP BY parent_no), n AS (SELECT parent_no, lead(parent_no) OVER (ORDER BY parent_no) AS next_no FROM ({t.SQL_PARENTS}) WHERE document_title IS NOT NULL),
dots AS (SELECT n.parent_no, next_no, sum(a.v * b.v) AS dot FROM n JOIN u a ON a.parent_no = n.parent_no JOIN u b ON b.parent_no = next_no AND b.slot = a.slot GROUP BY ALL)
SELECT n.parent_no, n.next_no, round(coalesce(dot / (a.size * b.size), 0.0), 6) AS cosine FROM n LEFT JOIN dots USING (parent_no, next_no) LEFT JOIN sizes a ON a.parent_no = n.parent_no LEFT JOIN sizes b ON b.parent_no = n.next_no WHERE n.next_no IS NOT NULL""",
    "source_validation": f"""WITH {t.SQL_RECORDS}, p AS ({t.SQL_PARENTS}), cores AS (SELECT parent_id, session_id, {t.sql_norm("core_text")} AS core FROM p), sources AS (SELECT session_id, {t.sql_norm("text")} AS source FROM rec),
pairs AS (SELECT parent_id, length(source) > 0 AND (contains(core, substring(source, 1, 80)) OR contains(source, substring(core, 1, 80))) AS hit FROM cores JOIN sources USING (session_id))
SELECT parent_id, count(*) AS n_refs, count(*) AS n_found, CASE WHEN count(*) FILTER (hit) = 0 THEN 'source-chunk-mismatch' ELSE 'valid' END AS reason FROM pairs GROUP BY parent_id""",
    "evidence_gate": f"""SELECT parent_no, CASE WHEN coalesce(trim(core_text), '') = '' THEN 'empty-parent' WHEN session_id IS NULL THEN 'no-source-refs' WHEN coalesce(evidence_quality, 0) < 0.8 THEN 'low-evidence-quality'
  WHEN NOT coalesce(temporal_current, true) THEN 'temporal-mismatch' ELSE 'eligible' END AS reason FROM ({t.SQL_PARENTS})""",
}
