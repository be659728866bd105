"""Hybrid retrieval: recall of children, admission, aggregation to parents, coverage selection, result.

Tables, all keyed so that a scope's data meets by equi-joins:

* queries ``query_id, scope, text, vector, vector_model``
* children ``scope, parent_id, child_id, text, vector, vector_model``
* parents ``scope, parent_id, document_id, turn, eligible, source_valid, conflict, updated_at, view`` (``view`` is the
  current text)
"""

from __future__ import annotations

from bisect import bisect_right
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith import storage
from stratalith.config import Config
from stratalith.functions import text, vector

#: Queries and rows that meet in one block.
QUERY_BLOCK, ROW_BLOCK = 1024, 8192
#: Queries that a block of candidates holds at a time, and pairs that it gives out at a time, where all pairs are wanted.
ASKED, PAIRS = 16384, 65536
EMPTY = pa.list_(pa.string())


def subqueries(queries: DataFrame, split: bool = True, config: Config = Config()) -> DataFrame:
    """One row per query and sub-query: S0 is the whole text, S1.. its clauses."""
    whole = F.regexp_replace(text.nonblank(F.col("text")), r"(?U)^\s+|\s+$", "")
    parts = text.decompose(F.col("text"), extra=config.stopwords)["subqueries"] if split else F.array().cast("array<string>")
    out = queries.withColumn("parts", F.concat(F.array(whole), parts)).select("*", F.posexplode("parts").alias("sub", "sub_text"))
    return out.filter("sub_text <> ''").drop("parts", "text")


def in_blocks(queries: DataFrame, rows: DataFrame, query_key: str, row_key: str, by: str | None = None):
    """Both sides with ``qb, rb``, so that every query meets every row of its ``by`` once: each side is cut into blocks by
    the hash of its key, as many as its rows ask for, and goes to all blocks of the other."""
    on = [by] if by else []
    if by:
        many = lambda df, size, name: df.groupBy(by).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
        counts = storage.materialize(many(queries, QUERY_BLOCK, "nq").join(many(rows, ROW_BLOCK, "nr"), by), "blocks")
        place = lambda df: df.join(counts, by)
    else:
        sizes = {"nq": max(1, -(-queries.count() // QUERY_BLOCK)), "nr": max(1, -(-rows.count() // ROW_BLOCK))}
        place = lambda df: df.withColumns({n: F.lit(v) for n, v in sizes.items()})
    mine = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = place(queries).withColumn("qb", mine(query_key, "nq")).withColumn("rb", every("nr")).drop("nq", "nr")
    r = place(rows).withColumn("rb", mine(row_key, "nr")).withColumn("qb", every("nq")).drop("nq", "nr")
    keys = [*on, "qb", "rb"]
    return q.groupBy(*keys).cogroup(r.groupBy(*keys))


def first_by(keys: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """Positions of the ``k`` first by the keys, the last one first (as lexsort)."""
    lead = keys[-1]
    if len(lead) <= k:
        return np.lexsort(keys)
    at = np.flatnonzero(lead <= np.partition(lead, k - 1)[k - 1])
    return at[np.lexsort([x[at] for x in keys])[:k]]


class Postings:
    """Rows of a block by token, and their texts as one, for queries that come one after another."""

    def __init__(self, queries: pa.Table, rows: pa.Table):
        tokens = [t.column("tokens").combine_chunks().fill_null(pa.scalar([], EMPTY)) for t in (queries, rows)]
        code = pa.concat_arrays([t.flatten() for t in tokens]).dictionary_encode()
        ids, split = code.indices.to_numpy(), len(tokens[0].flatten())
        self.names, self.n = code.dictionary, len(rows)
        sizes = [t.value_lengths().to_numpy() for t in tokens]
        self.of_query = np.split(ids[:split], np.cumsum(sizes[0])[:-1])
        self.of_row = np.split(ids[split:], np.cumsum(sizes[1])[:-1])
        order = np.argsort(ids[split:], kind="stable")
        self.row = np.repeat(np.arange(self.n), sizes[1])[order]
        self.edge = np.searchsorted(ids[split:][order], np.arange(len(self.names) + 1))
        self.strong = np.split(queries.column("strong").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(bool), np.cumsum(sizes[0])[:-1])
        texts = rows.column("norm").to_pylist()
        self.phrases, self.texts, self.whole = queries.column("norm").to_pylist(), texts, "\0".join(texts)
        self.starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).tolist()

    def hits(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: tokens shared with the i-th query, strong ones among them, and whether the query stands in its text."""
        at = [self.row[self.edge[t] : self.edge[t + 1]] for t in self.of_query[i]]
        count = lambda parts: np.bincount(np.concatenate(parts), minlength=self.n) if parts else np.zeros(self.n, np.int64)
        phrase, words = np.zeros(self.n, bool), self.phrases[i]
        if len(words) >= 3 and "\0" in words:
            phrase[:] = [words in t for t in self.texts]
        elif len(words) >= 3:
            found = self.whole.find(words)
            while found >= 0:
                row = bisect_right(self.starts, found) - 1
                phrase[row] = True
                found = self.whole.find(words, self.starts[row + 1])
        return count(at), count([a for a, strong in zip(at, self.strong[i]) if strong]), phrase

    def shared(self, i: int, row: int) -> list[str]:
        return sorted(self.names.take(pa.array(np.intersect1d(self.of_query[i], self.of_row[row]))).to_pylist())


def lexical_scores(phrase: np.ndarray, coverage: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """The steps of :func:`text.lexical_score` for arrays."""
    return np.select([phrase, coverage >= 0.75, strong >= 2, coverage >= 0.5, coverage >= 0.25], [1.0, 0.85, 0.80, 0.70, 0.35], 0.0)


def cosines(queries: pa.Table, rows: pa.Table) -> np.ndarray:
    """Cosines, at least 0, of vectors of one model and length with usable norms; 0 for others."""
    return np.maximum(np.nan_to_num(_signed(queries, rows)), 0.0)


def _signed(queries: pa.Table, rows: pa.Table) -> np.ndarray:
    """Cosines rounded to 12 digits; not a number where there is none."""
    out = np.full((len(queries), len(rows)), np.nan)

    def sides(t: pa.Table) -> dict:
        v = t.column("vector").combine_chunks()
        sizes, models, by = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), t.column("model").to_pylist(), {}
        for i, key in enumerate(zip(models, sizes)):
            if key[0] is not None and key[1]:
                by.setdefault(key, []).append(i)
        found = {}
        for (model, size), at in by.items():
            x = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
            norm = np.sqrt((x * x).sum(axis=1))
            ok = np.isfinite(norm) & (norm > 0)
            found[model, size] = np.array(at)[ok], x[ok] / norm[ok, None]
        return found

    left, right = sides(queries), sides(rows)
    for key in left.keys() & right.keys():
        out[np.ix_(left[key][0], right[key][0])] = np.round(left[key][1] @ right[key][1].T, 12)
    return out


def scored(subs: DataFrame, children: DataFrame, config: Config = Config()) -> DataFrame:
    """Of every sub-query those children of its scope, with a score above 0, that a later stage can take.

    Every sub-query is scored against every child of its scope, in blocks, but a block gives out only the rows that are
    among its first by score, its first anchored ones, or the best of its first parents in the order of the guarantee.
    What the later stages take from all rows is among these, and their number doesn't grow with the scope.
    """
    q = subs.select("query_id", "sub", "scope", text.normalize(F.col("sub_text")).alias("norm"), text.informative_tokens(F.col("sub_text"), config.stopwords).alias("tokens"), "vector", F.col("vector_model").alias("model"))
    q = q.withColumn("strong", F.transform("tokens", text.is_strong))
    c = children.select("scope", "parent_id", "child_id", text.normalize(F.col("text")).alias("norm"), text.lexical_tokens(F.col("text")).alias("tokens"), "vector", F.col("vector_model").alias("model"))
    few, parents = max(2, config.child_top_k), config.child_top_k + config.lexical_guarantee
    kinds = dict(subs.dtypes)
    shape = f"query_id {kinds['query_id']}, sub int, scope {kinds['scope']}, parent_id string, child_id string, tokens array<string>, coverage double, n_strong int, phrase boolean, lexical double, dense double, score double, anchor boolean"

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in shape.split(", ")]
        at, kept, measures = [], [], []
        if len(left) and len(right):
            postings, dense = Postings(left, right), cosines(left, right)
            by_id = np.argsort(np.argsort(np.array(right.column("child_id").to_pylist(), object), kind="stable"))
            parent = right.column("parent_id").combine_chunks().dictionary_encode().indices.to_numpy()
            for i in range(len(left)):
                matched, strong, phrase = postings.hits(i)
                coverage = matched / max(1, len(postings.of_query[i]))
                lexical = lexical_scores(phrase, coverage, strong)
                score = np.maximum(lexical, dense[i])
                some = np.flatnonzero(score > 0)
                anchored = some[(phrase | (strong >= 1))[some]]
                order = lambda r: (by_id[r], -dense[i, r], -score[r])
                by_parent = anchored[np.lexsort((by_id[anchored], -score[anchored], -dense[i, anchored], -strong[anchored], -coverage[anchored], ~phrase[anchored]))]
                best = np.sort(np.unique(parent[by_parent], return_index=True)[1])[:parents]
                take = np.unique(np.concatenate([some[first_by(order(some), few)], anchored[first_by(order(anchored), few)], by_parent[best]]))
                at.append(np.full(len(take), i))
                kept.append(take)
                measures.append((coverage[take], strong[take], phrase[take], lexical[take], dense[i, take], score[take]))
        i, r = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, kept))
        m = [np.concatenate([x[j] for x in measures]) if measures else np.zeros(0) for j in range(6)]
        tokens = pa.array([postings.shared(a, b) for a, b in zip(i, r)], EMPTY)
        columns = [left.column("query_id").take(pa.array(i)), left.column("sub").take(pa.array(i)).cast(pa.int32()), left.column("scope").take(pa.array(i)), right.column("parent_id").take(pa.array(r)), right.column("child_id").take(pa.array(r)), tokens]
        columns += [pa.array(m[0]), pa.array(m[1].astype(np.int32)), pa.array(m[2].astype(bool)), *(pa.array(x) for x in m[3:]), pa.array(m[2].astype(bool) | (m[1] >= 1))]
        return pa.table(dict(zip(names, columns)))

    return in_blocks(q.withColumn("asked", F.xxhash64("query_id", "sub")), c, "asked", "child_id", "scope").applyInArrow(work, shape)


def ranked(rows: DataFrame, parents: DataFrame, config: Config = Config()) -> DataFrame:
    """Rank among the sub-query's rows, margins, and the strength with which a row covers it."""
    w = Window.partitionBy("query_id", "sub").orderBy(F.desc("score"), F.desc("dense"), "child_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gate = parents.select("scope", "parent_id", "eligible", "source_valid")
    rows = rows.join(gate, ["scope", "parent_id"])
    rows = rows.withColumn("rank", F.row_number().over(w) - 1).withColumn("top", F.first("score").over(whole)).withColumn("second", F.coalesce(F.nth_value("score", 2).over(whole), F.lit(0.0)))
    lead = F.col("rank") == 0
    rows = rows.withColumn("margin", F.when(lead, F.greatest(F.lit(0.0), F.col("score") - F.col("second"))).otherwise(0.0))
    rows = rows.withColumn("in_window", F.col("score") >= F.greatest(F.lit(0.0), F.col("top") - config.relative_score_window))
    lexical = F.col("coverage") >= config.coverage_lexical_minimum
    dense = lead & (F.col("dense") >= config.coverage_dense_minimum) & (F.col("margin") >= config.coverage_dense_margin)
    strong = F.col("phrase") | lexical | dense
    strength = F.when(F.col("phrase"), 1.0).when(lexical, F.greatest(F.lit(0.55), "coverage")).when(strong, F.least(F.lit(0.90), 0.60 + 4 * F.col("margin"))).when(lead, 0.20).otherwise(0.0)
    return rows.withColumn("strong", strong).withColumn("strength", strength).withColumn("covers", strong | lead)


def admitted(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """The first rows of each sub-query that have an anchor, lie within the score window, or lead and may be used."""
    guard = (F.col("rank") == 0) & F.col("eligible") & F.col("source_valid")
    fit = rows.filter(F.col("anchor") | F.col("in_window") | guard)
    n = F.row_number().over(Window.partitionBy("query_id", "sub").orderBy("rank"))
    reason = F.when(F.col("anchor"), "lexical-anchor").when(F.col("in_window"), "relative-window").otherwise("top1-recall-guard")
    out = fit.withColumn("n", n).filter(F.col("n") <= config.child_top_k).withColumn("reason", reason)
    return out.withColumn("tier", F.when(F.col("strong"), "strong").otherwise("weak-top1-fallback")).drop("n")


def guaranteed(rows: DataFrame, taken: DataFrame, config: Config = Config()) -> DataFrame:
    """Anchored rows of parents that the sub-query didn't admit: the best of each parent, and of these the first few."""
    rest = rows.filter("anchor").join(taken.select("query_id", "sub", "parent_id").distinct(), ["query_id", "sub", "parent_id"], "left_anti")
    order = [F.desc("phrase"), F.desc("coverage"), F.desc("n_strong"), F.desc("dense"), F.asc("rank")]
    best = rest.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "sub", "parent_id").orderBy(*order))).filter("n = 1")
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "sub").orderBy(*order))).filter(F.col("n") <= config.lexical_guarantee)
    out = best.withColumn("covers", (F.col("coverage") >= 0.20) | (F.col("n_strong") >= 2)).withColumn("strength", F.greatest(F.lit(0.50), "coverage"))
    return out.withColumn("margin", F.lit(0.0)).withColumn("strong", F.lit(True)).withColumn("reason", F.lit("lexical-guarantee")).withColumn("tier", F.lit("strong")).drop("n")


def union_top(hits: DataFrame, config: Config = Config()) -> DataFrame:
    """Hits of the children with the highest priority of each query."""
    each = F.col("score") + 0.15 * F.col("strength") + 0.20 * F.col("coverage")
    keys = ["query_id", "parent_id", "child_id"]
    top = hits.groupBy(*keys).agg(F.max(each).alias("priority"), F.min(F.struct("sub", "rank")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("priority"), "first", "parent_id", "child_id")
    top = top.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= config.child_union_limit)
    return hits.join(top.select(*keys, "priority", "place"), keys)


def coverage(hits: DataFrame) -> DataFrame:
    """Of each parent and sub-query the hit that covers it best, as struct ``c``."""
    best = F.max_by(F.struct("sub", "tier", "strength", "score", "reason"), F.struct("strength", "score", F.negative("rank")))
    return hits.filter("covers").groupBy("query_id", "scope", "parent_id", "sub").agg(best.alias("c"))


def measured(hits: DataFrame) -> DataFrame:
    """One row per query and parent with the measures of its hits."""
    two = F.slice(F.sort_array(F.collect_list("dense"), asc=False), 1, 2)
    return hits.groupBy("query_id", "scope", "parent_id").agg(
        F.max("dense").alias("best_dense"),
        F.aggregate(two, F.lit(0.0), lambda a, x: a + x).alias("top_sum"),
        F.least(F.count("*"), F.lit(2)).alias("top_n"),
        F.max("lexical").alias("lexical"),
        F.count_if("anchor").alias("anchors"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("tokens"),
        F.array_sort(F.collect_set("reason")).alias("reasons"),
    )


def aggregated(hits: DataFrame, parents: DataFrame, config: Config = Config()) -> DataFrame:
    """One row per query and parent, ranked by nine keys; the first few are kept before qualification."""
    by_sub = coverage(hits).groupBy("query_id", "scope", "parent_id").agg(F.array_sort(F.collect_list("c")).alias("cover"))
    rows = measured(hits)
    rows = rows.join(by_sub, ["query_id", "scope", "parent_id"], "left").join(parents, ["scope", "parent_id"])
    cover = F.filter(F.coalesce("cover", F.array()), lambda c: c["sub"] > 0)
    rows = rows.withColumn("cover", cover).withColumn("top_avg", F.col("top_sum") / F.col("top_n")).drop("top_sum", "top_n")
    rows = rows.withColumn("n_covered", F.size("cover")).withColumn("n_strong", F.size(F.filter("cover", lambda c: c["tier"] == "strong")))
    rows = rows.withColumn("relevance", F.greatest("best_dense", "lexical")).withColumn("qualified", F.col("eligible") & F.col("source_valid"))
    order = [F.desc("n_strong"), F.desc("n_covered"), F.desc("anchors"), F.desc("lexical"), F.desc("top_avg"), F.desc("best_dense"), F.desc("relevance"), F.desc_nulls_last("updated_at"), F.asc("parent_id")]
    rows = rows.withColumn("parent_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return rows.filter(F.col("parent_rank") <= config.parent_eligible_limit)


def choose(gain: np.ndarray, base: np.ndarray, place: np.ndarray, alike: np.ndarray, limit: int) -> list[tuple[int, float]]:
    """Parents (by position, in order of rank) that cover the targets with little redundancy, and their values.

    ``gain`` is what a parent (row) adds if a target (column) is still open, ``alike`` the share of tokens that two parents
    have in common. Without targets every parent counts, the first one more.
    """
    n, targets = gain.shape
    least = min(limit, max(2, targets)) if targets else limit
    free, open_targets, near = np.ones(n, bool), np.ones(targets, bool), np.zeros(n)
    picks: list[tuple[int, float]] = []
    while free.any() and len(picks) < limit and (len(picks) < least or open_targets.any()):
        fresh = gain[:, open_targets].sum(axis=1)
        able = free & ((fresh > 0) | (len(picks) < least))
        lead = np.where(fresh > 0, fresh, 0.25) if targets else np.full(n, 0.30 if picks else 1.0)
        seen = np.isin(place, place[[p for p, _ in picks]]) if picks else np.zeros(n, bool)
        value = np.where(able, lead + base + 0.15 * ~seen - 0.75 * near, 0.0)
        best = int(value.argmax())
        if value[best] <= 0:
            break
        picks.append((best, float(value[best])))
        free[best], near = False, np.maximum(near, alike[best])
        open_targets &= gain[best] <= 0
    return picks


def selected(parents: DataFrame, subs: DataFrame, config: Config = Config()) -> DataFrame:
    """``query_id, pick, parent_id, value`` from the ranked parents.

    A query is one row with its parents, at most ``parent_eligible_limit``; many queries make one Arrow batch. The tokens
    of a parent's view are made once, however many queries rank it.
    """
    targets = subs.groupBy("query_id").agg(F.array_sort(F.collect_set(F.when(F.col("sub") > 0, F.col("sub")))).alias("targets"))
    fit = parents.filter("qualified")
    views = fit.groupBy("scope", "parent_id").agg(F.max("view").alias("view"))
    views = views.select("scope", "parent_id", F.array_sort(F.transform(text.informative_tokens(F.col("view"), config.stopwords), lambda t: F.xxhash64(t))).alias("view_tokens"))
    place = F.xxhash64(F.coalesce("document_id", F.lit("")), F.coalesce(F.col("turn").cast("string"), F.lit("")))
    cover = F.transform("cover", lambda c: F.struct(c["sub"].alias("sub"), (F.when(c["tier"] == "strong", 2.0).otherwise(0.65) * F.greatest(F.lit(0.20), c["strength"])).alias("gain")))
    base = F.col("best_dense") + F.least(F.lit(0.45), 0.15 * F.col("anchors"))
    rows = fit.join(views, ["scope", "parent_id"]).select("query_id", F.struct("parent_rank", "parent_id", base.alias("base"), place.alias("place"), cover.alias("cover"), "view_tokens").alias("p"))
    rows = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("p")).alias("parents")).join(targets, "query_id").select("query_id", "parents", "targets")
    limit = config.parent_select_limit

    def shares(tokens: list) -> np.ndarray:
        out = np.zeros((len(tokens), len(tokens)))
        for i, a in enumerate(tokens):
            for j, b in enumerate(tokens[:i]):
                if a and b:
                    out[i, j] = out[j, i] = len(a & b) / min(len(a), len(b))
        return out

    def run(batches):
        for batch in batches:
            at, out = [], []
            for i, (found, wanted) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                column = {t: j for j, t in enumerate(wanted)}
                gain = np.zeros((len(found), len(wanted)))
                for r, p in enumerate(found):
                    for c in p["cover"]:
                        if c["sub"] in column:
                            gain[r, column[c["sub"]]] += c["gain"]
                picks = choose(gain, np.array([p["base"] for p in found]), np.array([p["place"] for p in found]), shares([set(p["view_tokens"]) for p in found]), limit)
                at += [i] * len(picks)
                out += [(n, found[p]["parent_id"], v) for n, (p, v) in enumerate(picks)]
            pick, parent, value = zip(*out) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(pick, pa.int32()), pa.array(parent, pa.string()), pa.array(value, pa.float64())], names=["query_id", "pick", "parent_id", "value"])

    return rows.mapInArrow(run, f"query_id {dict(rows.dtypes)['query_id']}, pick int, parent_id string, value double")


def result(queries: DataFrame, subs: DataFrame, parents: DataFrame, picks: DataFrame) -> DataFrame:
    """One row per query: selected parents, covered and uncovered sub-queries, whether they suffice, and why not."""
    chosen = picks.join(parents.select("query_id", "parent_id", "cover"), ["query_id", "parent_id"])
    chosen = chosen.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pick", "parent_id"))), lambda x: x["parent_id"]).alias("found"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("cover", lambda c: c["sub"]))))).alias("covered"))
    facts = parents.groupBy("query_id").agg(F.count("*").alias("n_parents"), F.bool_or("conflict").alias("conflict"), F.array_sort(F.collect_list(F.when(F.col("qualified"), F.struct("parent_rank", "relevance")))).alias("q"))
    targets = subs.groupBy("query_id").agg(F.array_sort(F.collect_set(F.when(F.col("sub") > 0, F.col("sub")))).alias("targets"))
    rows = queries.select("query_id", text.nonblank(F.col("text")).alias("text")).join(targets, "query_id", "left").join(facts, "query_id", "left").join(chosen, "query_id", "left")
    none = F.array().cast("array<int>")
    rows = rows.withColumn("found", F.coalesce("found", F.array().cast("array<string>"))).withColumn("covered", F.array_intersect(F.coalesce("covered", none), F.coalesce("targets", none)))
    rows = rows.withColumn("uncovered", F.array_except(F.coalesce("targets", none), "covered")).withColumn("n_parents", F.coalesce("n_parents", F.lit(0))).withColumn("conflict", F.coalesce("conflict", F.lit(False)))
    coref, temporal = F.col("text").rlike(text.COREFERENCE), F.col("text").rlike(text.TEMPORAL)
    rows = rows.withColumn("sufficient", (F.size("found") > 0) & (F.size("uncovered") == 0) & ~coref & ~F.col("conflict"))
    any_parent = F.col("n_parents") > 0
    reasons = F.array_compact(F.array(F.when(coref & any_parent, F.lit("coreference")), F.when(temporal & (F.col("n_parents") > 1), F.lit("temporal-ambiguity")), F.when((F.size("uncovered") > 0) & any_parent, F.lit("uncovered-subqueries")), F.when(F.col("conflict"), F.lit("conflict"))))
    margin = F.coalesce(F.try_element_at("q", F.lit(1))["relevance"], F.lit(0.0)) - F.coalesce(F.try_element_at("q", F.lit(2))["relevance"], F.lit(0.0))
    kept = F.when(F.col("sufficient"), F.col("found")).otherwise(F.array().cast("array<string>"))
    return rows.select("query_id", "sufficient", kept.alias("selected"), "found", "covered", "uncovered", reasons.alias("reasons"), (~F.col("sufficient") & any_parent & (F.size(reasons) > 0)).alias("needs_planner"), margin.alias("margin"), "n_parents")


class Retrieval:
    """The stages of a set of queries, each made when it is first used.

    Rows, hits and parents feed several later stages, so they are written once to the shared folder.
    """

    def __init__(self, queries: DataFrame, children: DataFrame, parents: DataFrame, split: bool = True, config: Config = Config()):
        self.queries, self.children, self.candidates, self.split, self.config = queries, children, parents, split, config

    @cached_property
    def subs(self) -> DataFrame:
        return subqueries(self.queries, self.split, self.config)

    @cached_property
    def rows(self) -> DataFrame:
        gate = storage.materialize(self.candidates.select("scope", "parent_id").distinct(), "gate")  # its size is known, so a small one is sent rather than shuffled
        known = self.children.join(gate, ["scope", "parent_id"], "left_semi")
        return storage.materialize(ranked(scored(self.subs, known, self.config), self.candidates, self.config), "rows")

    @cached_property
    def admitted(self) -> DataFrame:
        return admitted(self.rows, self.config)

    @cached_property
    def guaranteed(self) -> DataFrame:
        return guaranteed(self.rows, self.admitted, self.config)

    @cached_property
    def hits(self) -> DataFrame:
        both = storage.materialize(self.admitted.unionByName(self.guaranteed), "union")
        return storage.materialize(union_top(both, self.config), "hits")

    @cached_property
    def parents(self) -> DataFrame:
        return storage.materialize(aggregated(self.hits, self.candidates, self.config), "parents")

    @cached_property
    def picks(self) -> DataFrame:
        return storage.materialize(selected(self.parents, self.subs, self.config), "picks")

    @cached_property
    def result(self) -> DataFrame:
        return result(self.queries, self.subs, self.parents, self.picks)


def with_fallback(queries: DataFrame, sensory: tuple[DataFrame, DataFrame], bank: tuple[DataFrame, DataFrame], split: bool = True, config: Config = Config()) -> DataFrame:
    """Results of the first stage, and, only for queries that it doesn't settle, of both layers together."""
    first = storage.materialize(Retrieval(queries, *sensory, split, config).result.withColumn("stage", F.lit("sensory")), "first")
    open_ids = first.filter((F.size("found") == 0) | (F.size("uncovered") > 0)).select("query_id")
    rest = queries.join(open_ids, "query_id", "left_semi")
    both = Retrieval(rest, sensory[0].unionByName(bank[0]), sensory[1].unionByName(bank[1]), split, config).result.withColumn("stage", F.lit("sensory+bank"))
    return first.join(open_ids, "query_id", "left_anti").unionByName(both)


def _hits_of(left: pa.Table, right: pa.Table):
    """Batches of all pairs with a score above 0; queries of equal text, one after another in ``left``, are scored once.

    A word between two spaces of a query's text is a word between spaces of every text that the query stands in. So only
    texts that have all tokens of such words are searched for it.
    """
    postings = Postings(left, right)
    inner = np.split(left.column("inner").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(bool), np.cumsum([len(t) for t in postings.of_query])[:-1])
    asking, ids = left.column("id").combine_chunks(), right.column("id").combine_chunks()
    found, n = [], 0

    def batch() -> pa.RecordBatch:
        query = np.repeat([i for i, _ in found], [len(x[0]) for _, x in found])
        row, *m = (np.concatenate([x[j] for _, x in found]) for j in range(6))
        return pa.RecordBatch.from_arrays([asking.take(pa.array(query)), ids.take(pa.array(row)), *map(pa.array, m)], names=["query_id", "candidate_id", "matched", "n_strong", "coverage", "phrase", "score"])

    for i, tokens in enumerate(postings.of_query):
        words = postings.phrases[i]
        if not i or words != postings.phrases[i - 1]:
            at = [postings.row[postings.edge[t] : postings.edge[t + 1]] for t in tokens]
            count = lambda keep: np.bincount(np.concatenate([np.zeros(0, np.int64), *(a for a, k in zip(at, keep) if k)]), minlength=len(right))  # noqa: B023, E731
            matched, phrase = count(np.ones(len(at), bool)), np.zeros(len(right), bool)
            if len(words) >= 3:
                fit = np.flatnonzero((matched > 0) & (count(inner[i]) == inner[i].sum()))
                phrase[[r for r in fit.tolist() if words in postings.texts[r]]] = True
            some = np.flatnonzero(matched)
            m = matched[some], count(postings.strong[i])[some], matched[some] / max(1, len(tokens)), phrase[some]
            score = lexical_scores(m[3], m[2], m[1])
            hits = tuple(x[score > 0] for x in (some, *m, score))
        if len(hits[0]):
            found.append((i, hits))
            n += len(hits[0])
        if n >= PAIRS:
            yield batch()
            found, n = [], 0
    if n:
        yield batch()


def _every_hit(batches):
    """Of one block: its candidates come first, then all queries, a part of which is held at a time."""
    rows, asked, n = [], [], 0
    for batch in batches:
        rows.append(batch.filter(pc.invert(batch.column("asks"))))
        asked.append(batch.filter(batch.column("asks")))
        n += len(asked[-1])
        if n >= ASKED:
            yield from _hits_of(pa.Table.from_batches(asked), pa.Table.from_batches(rows))
            asked, n = [], 0
    if n:
        yield from _hits_of(pa.Table.from_batches(asked), pa.Table.from_batches(rows))


def lexical_recall(queries: DataFrame, candidates: DataFrame, config: Config = Config(), k: int | None = None) -> DataFrame:
    """Lexical score of every candidate that shares an informative token with a query.

    ``queries`` has ``query_id, text``, ``candidates`` has ``candidate_id, text`` (bigint ids). With ``k`` the best k of each
    query: queries meet candidates in blocks, which give out k rows each. Else all: candidates are spread over blocks once,
    the queries go to each of them, and the pairs are given out as they are found, so no pair is ever shuffled or sorted.
    """
    measures = "matched bigint, n_strong bigint, coverage double, phrase boolean, score double"
    if k is not None:
        q = queries.select("query_id", text.normalize(F.col("text")).alias("norm"), text.informative_tokens(F.col("text"), config.stopwords).alias("tokens")).withColumn("strong", F.transform("tokens", text.is_strong))
        c = candidates.select("candidate_id", text.normalize(F.col("text")).alias("norm"), text.lexical_tokens(F.col("text")).alias("tokens"))

        def work(left: pa.Table, right: pa.Table) -> pa.Table:
            at, kept, found = [], [], []
            if len(left) and len(right):
                postings, ids = Postings(left, right), right.column("candidate_id").to_numpy()
                for i in range(len(left)):
                    matched, strong, phrase = postings.hits(i)
                    coverage = matched / max(1, len(postings.of_query[i]))
                    score = lexical_scores(phrase, coverage, strong)
                    some = np.flatnonzero((matched > 0) & (score > 0))
                    take = some[first_by((ids[some], -coverage[some], -score[some]), k)]
                    at.append(np.full(len(take), i)), kept.append(take), found.append((matched[take], strong[take], coverage[take], phrase[take], score[take]))
            i, r = (pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (at, kept))
            m = [np.concatenate([x[j] for x in found]) if found else np.zeros(0) for j in range(5)]
            columns = [left.column("query_id").take(i), right.column("candidate_id").take(r), *(pa.array(x.astype(t)) for x, t in zip(m, (np.int64, np.int64, float, bool, float)))]
            return pa.table(dict(zip(["query_id", "candidate_id", *(x.split()[0] for x in measures.split(", "))], columns)))

        best = in_blocks(q, c, "query_id", "candidate_id").applyInArrow(work, f"query_id bigint, candidate_id bigint, {measures}")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("coverage"), "candidate_id")
        return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    # a block of candidates has a partition of its own, where the candidates come before the queries
    blocks = max(1, -(-candidates.count() // ROW_BLOCK))
    c = candidates.select(F.pmod(F.xxhash64("candidate_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), F.col("candidate_id").alias("id"), "text")
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), F.col("query_id").alias("id"), "text")
    both = c.unionByName(q).repartitionById(blocks, "block").sortWithinPartitions("asks", F.when(F.col("asks"), F.col("text")))
    both = both.select("asks", "id", text.normalize(F.col("text")).alias("norm"), text.lexical_tokens(F.col("text")).alias("tokens"))
    asked = lambda x: F.when(F.col("asks"), x)
    middle = text.lexical_tokens(F.regexp_replace("norm", "^[^ ]* ?|[^ ]*$", ""))
    both = both.withColumn("tokens", asked(text.informative(F.col("tokens"), config.stopwords)).otherwise(F.col("tokens"))).withColumn("middle", asked(middle))
    both = both.select("asks", "id", "norm", "tokens", asked(F.transform("tokens", text.is_strong)).alias("strong"), asked(F.transform("tokens", lambda t: F.array_contains("middle", t))).alias("inner"))
    return both.mapInArrow(_every_hit, f"query_id bigint, candidate_id bigint, {measures}")


def validated(refs: DataFrame, sources: DataFrame, parents: DataFrame) -> DataFrame:
    """``parent_id, n_refs, n_found, n_matching, reason``: whether a parent's text stands in one of its sources.

    ``refs`` has ``parent_id, session_id, seq``; ``sources`` has ``session_id, seq, text``. Either text must contain the
    other's first 80 characters, compared without case and extra white space (the length is part of the rule).
    """
    rows = refs.join(sources.select("session_id", "seq", text.normalize(F.col("text")).alias("source")), ["session_id", "seq"], "left")
    rows = rows.join(parents.select("parent_id", text.normalize(F.col("view")).alias("core")), "parent_id")
    hit = (F.length("source") > 0) & (F.contains("core", F.substring("source", 1, 80)) | F.contains("source", F.substring("core", 1, 80)))
    out = rows.groupBy("parent_id").agg(F.count("*").alias("n_refs"), F.count("source").alias("n_found"), F.count_if(F.coalesce(hit, F.lit(False))).alias("n_matching"))
    reason = F.when(F.col("n_found") == 0, "source-missing").when(F.col("n_matching") == 0, "source-chunk-mismatch").otherwise("valid")
    return out.withColumn("reason", reason)


def eligibility(core: Column, n_refs: Column, quality: Column, conflict: Column, current: Column, vector_state: Column, config: Config = Config()) -> Column:
    """The first rule that a candidate breaks, else ``eligible``."""
    return (
        F.when(text.collapse(core) == "", "empty-parent")
        .when(F.coalesce(n_refs, F.lit(0)) == 0, "no-source-refs")
        .when(F.coalesce(quality, F.lit(0.0)) < config.evidence_quality_threshold, "low-evidence-quality")
        .when(F.coalesce(conflict, F.lit(False)), "unresolved-conflict")
        .when(~F.coalesce(current, F.lit(True)), "temporal-mismatch")
        .when(vector_state == "pending-vector", "pending-vector")
        .otherwise("eligible")
    )


def dense_top(queries: DataFrame, rows: DataFrame, k: int = 8) -> DataFrame:
    """Exact top k by cosine: queries meet rows in blocks, each one matrix product that gives out k rows of each query.

    ``queries`` has ``query_id, vector``, ``rows`` has ``row_id, vector`` (bigint ids). Vectors of another length, zero and
    null vectors have no cosine.
    """
    sides = lambda df, key: df.select(F.col(key).cast("bigint").alias(key), F.col("vector").cast("array<double>").alias("vector"), F.lit("").alias("model")).filter(F.exists("vector", lambda x: x != 0))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        at, kept, far = [], [], []
        if len(left) and len(right):
            ids, s = right.column("row_id").to_numpy(), _signed(left, right)
            for i in range(len(left)):
                some = np.flatnonzero(np.isfinite(s[i]))
                take = some[first_by((ids[some], -s[i, some]), k)]
                at.append(np.full(len(take), i)), kept.append(take), far.append(s[i, take])
        i, r = (pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (at, kept))
        return pa.table({"query_id": left.column("query_id").take(i), "row_id": right.column("row_id").take(r), "cosine": pa.array(np.concatenate(far) if far else np.zeros(0))})

    part = in_blocks(sides(queries, "query_id"), sides(rows, "row_id"), "query_id", "row_id").applyInArrow(work, "query_id bigint, row_id bigint, cosine double")
    best = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "row_id")
    return part.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
