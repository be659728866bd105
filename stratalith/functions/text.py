"""Text functions as column expressions, so that they stay in the JVM and within whole-stage code generation."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words without information (fixed values).
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "i", "in", "is", "it", "llm", "of", "on", "or", "that", "the", "this", "to", "user", "was", "were", "with")
#: Patterns (fixed values).
WORD = r"[a-z][\w-]*|\d+(?:\.\d+)?"
CJK = "[㐀-鿿]+"
CLAUSE = r"(?iU)(?:[。！？!?;；]\s*|，(?=(?:并且|以及|同时|然后|再|还|另|且))|\b(?:and|then|also)\b|(?:并且|以及|同时|然后|再问|还要))"
EDGES = r"(?U)^[，、：:\s]+|[，、：:\s]+$"
COREFERENCE = r"(?i)^\s*(?:it|that|this)\b|\b(?:that one|this one|the previous one|the last one)\b|(?:上次那个|此前那个|之前那个|^\s*它|^\s*那个)"
TEMPORAL = r"(?i)(?:截至|现在|当前|当时|何时|什么时候|as\s+of|currently|before\s+(?:that|then|\d)|after\s+(?:that|then|\d))"
UPDATE = r"(?i)(?:更新为|改为|变更为|现在(?:是|为)|当前.{0,24}(?:是|为)|updated?\s+to|changed?\s+to|now\s+is)"
REMEMBER = r"(?isU)^(?:请|麻烦|务必|请你)?\s*(?:帮我)?\s*(?:记住|记下|记牢|保存|长期记住)\s*[：:,，]?\s*(.+)$"
EVERYWHERE = r"(?i)(?:全局|跨工作区|所有项目|所有工作区|global|cross[- ]workspace)"
NEGATED = r"(?i)(?:不要|别|无需|不用|不必|并非|不是要|not\s+to|do\s+not)\s*(?:记住|记下|保存)"
QUOTED = r"(?i)(?:例如|示例|假设|如果用户说|这句话|提示词|正则|测试“?记住|quote|example)"
REVIEW = r"(?i)(?:(?:是否|要不要|该不该|需不需要).{0,16}(?:记住|记下|保存)|(?:should|do\s+we|maybe).{0,24}remember)"
SEQ_LABEL = r"^\[seq\s+\d+\]\s+\w+(?::\w+)?:\s*"


def nonblank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def estimate_tokens(c: Column) -> Column:
    """One token for each non-ASCII code point, ceil(n / 4) for each longest run of n ASCII characters; 0 for null."""
    runs = F.regexp_extract_all(nonblank(c), F.lit(r"[\x00-\x7F]+"), F.lit(0))
    ascii_tokens = F.aggregate(runs, F.lit(0).cast("bigint"), lambda a, r: a + F.floor((F.length(r) + 3) / 4))
    return ascii_tokens + F.length(F.regexp_replace(nonblank(c), r"[\x00-\x7F]", ""))


def estimate_input_tokens(system: Column, tools: Column, messages: Column) -> Column:
    """Tokens of a request: its system text, and its tools and messages (any structs or arrays) as JSON."""
    return estimate_tokens(system) + estimate_tokens(F.to_json(tools)) + estimate_tokens(F.to_json(messages))


def clean(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(nonblank(c), "\r\n?", "\n"), r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(nonblank(c), r"(?U)\s+", " "), r"^ | $", "")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normalisation; Spark has no expression for it, so it is applied only where asked for."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize(c: Column, unicode: bool = False) -> Column:
    return F.lower(collapse(nfkc(nonblank(c)) if unicode else c))


def _grams(run: Column, low: int, high: int) -> Column:
    widths = F.sequence(F.lit(low), F.lit(high))
    one = lambda w: F.when(F.length(run) >= w, F.transform(F.sequence(F.lit(1), F.length(run) - w + 1), lambda i: F.substring(run, i, w))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(widths, one))


def lexical_tokens(c: Column) -> Column:
    """Distinct words and numbers, and of each Chinese run itself and its parts of two to four characters."""
    t = normalize(c)
    runs = F.regexp_extract_all(t, F.lit(CJK), F.lit(0))
    parts = F.flatten(F.transform(runs, lambda r: F.concat(F.array(r), _grams(r, 2, 4))))
    return F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), parts))


def encoder_tokens(c: Column) -> Column:
    """Words and numbers with repeats; of Chinese runs their pairs, or the single character."""
    t = F.lower(nonblank(c))
    runs = F.regexp_extract_all(t, F.lit(CJK), F.lit(0))
    parts = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(_grams(r, 2, 2))))
    return F.concat(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), parts)


def informative(tokens: Column, extra: tuple[str, ...] = ()) -> Column:
    stop = F.array(*(F.lit(w) for w in (*STOPWORDS, *extra)))
    return F.filter(F.array_except(tokens, stop), lambda t: ~t.rlike("^[a-z]$"))


def informative_tokens(c: Column, extra: tuple[str, ...] = ()) -> Column:
    return informative(lexical_tokens(c), extra)


def is_strong(t: Column) -> Column:
    return (t.rlike(f"^{CJK}$") & (F.length(t) >= 2)) | (F.length(t) >= 3) | t.rlike(r"^\d{2,}$")


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens by the smaller set; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def lexical_score(phrase: Column, coverage: Column, strong: Column) -> Column:
    return F.when(phrase, 1.0).when(coverage >= 0.75, 0.85).when(strong >= 2, 0.80).when(coverage >= 0.5, 0.70).when(coverage >= 0.25, 0.35).otherwise(0.0)


def clauses(c: Column) -> Column:
    parts = F.transform(F.split(F.regexp_replace(nonblank(c), r"(?U)^\s+|\s+$", ""), CLAUSE), lambda p: F.regexp_replace(p, EDGES, ""))
    return F.filter(parts, lambda p: p != "")


def decompose(c: Column, limit: int = 3, extra: tuple[str, ...] = ()) -> Column:
    """Struct of ``subqueries`` and ``rejected`` (clause, reason). Clauses are taken in order up to ``limit``.

    A clause is refused as low-information (under 8 characters or 2 informative tokens) or as a duplicate (overlap over
    0.85 with one taken, or with the query if it is the only clause).
    """
    raw = clauses(c)
    empty = F.struct(F.array().cast("array<string>").alias("subqueries"), F.array().cast("array<struct<clause:string,reason:string>>").alias("rejected"))

    def step(acc: Column, clause: Column) -> Column:
        tokens = informative_tokens(clause, extra)
        poor = (F.length(clause) < 8) | (F.size(tokens) < 2)
        same = F.exists(acc["subqueries"], lambda s: overlap(informative_tokens(s, extra), tokens) > 0.85)
        twice = ((F.size(raw) == 1) & (overlap(informative_tokens(c, extra), tokens) > 0.85)) | same
        refused = lambda why: F.struct(acc["subqueries"].alias("subqueries"), F.concat(acc["rejected"], F.array(F.struct(clause.alias("clause"), F.lit(why).alias("reason")))).alias("rejected"))
        taken = F.struct(F.concat(acc["subqueries"], F.array(clause)).alias("subqueries"), acc["rejected"].alias("rejected"))
        return F.when(F.size(acc["subqueries"]) >= limit, acc).when(poor, refused("low-information")).when(twice, refused("duplicate")).otherwise(taken)

    return F.aggregate(raw, empty, step)


def label(title: Column, headings: Column, text: Column, key: Column) -> Column:
    """The title, else the heading path, else the first line without its sequence mark, else the id; 80 characters."""
    first = F.substring(F.trim(F.split_part(F.regexp_replace(nonblank(text), SEQ_LABEL, ""), F.lit("\n"), F.lit(1))), 1, 80)
    named = lambda c: F.when(F.length(c) > 0, F.substring(c, 1, 80))
    return F.coalesce(named(title), named(F.array_join(headings, " > ")), F.when(F.length(first) > 0, first), key)


def remember(c: Column) -> Column:
    """Struct ``content, scope_kind`` of an explicit request to remember, else null."""
    t = F.regexp_replace(nonblank(c), r"(?U)^\s+|\s+$", "")
    content = F.regexp_replace(F.regexp_extract(t, REMEMBER, 1), r"(?U)^\s+|\s+$", "")
    content = F.regexp_replace(content, r"(?i)^(?:(?:全局|跨工作区|所有项目|所有工作区|global|cross[- ]workspace)\s*)+[：:,，]\s*", "")
    valid = t.rlike(REMEMBER) & ~t.rlike(NEGATED) & ~t.rlike(QUOTED) & (F.length(content) >= 2)
    scope = F.when(t.rlike(EVERYWHERE), "user-global").otherwise("workspace")
    return F.when(valid, F.struct(content.alias("content"), scope.alias("scope_kind")))


def should_review(text: Column, enabled: Column, verified: Column) -> Column:
    return enabled & verified & nonblank(text).rlike(REVIEW)


def last_json(text: str | None) -> str | None:
    """The answer as JSON: the whole of it without a fence, else the last balanced value within prose; null if none."""
    if text is None:
        return None
    body = text.strip()
    if body.startswith("```"):
        body = body.strip("`").partition("\n")[2].rpartition("\n")[0] or body.strip("`")
    try:
        return json.dumps(json.loads(body))
    except ValueError:
        pass
    decoder, at, found = json.JSONDecoder(), 0, None
    while at < len(body):
        if body[at] in "{[":
            try:
                value, at = decoder.raw_decode(body, at)
                found = value
                continue
            except ValueError:
                pass
        at += 1
    return None if found is None else json.dumps(found)


def clip(value: str | None, limit: int, end: bool = False) -> str | None:
    """The longest prefix (or, with ``end``, suffix) of at most ``limit`` tokens."""
    if value is None:
        return None
    from stratalith.operators.chunker import Sizes

    size = Sizes(value)
    if size(0, len(value)) <= limit:
        return value
    if end:
        return value[size.tail(0, len(value), limit) :]
    cut = size.head(0, len(value), limit)
    return value[:cut] if size(0, cut) <= limit else ""


def clip_to_tokens(c: Column, limit: int, end: bool = False) -> Column:
    """Column form of :func:`clip`; texts of no more characters than ``limit`` never leave the JVM."""
    cut = F.pandas_udf(lambda s: s.map(lambda x: clip(x, limit, end)), StringType())
    return F.when(F.length(c) <= limit, c).otherwise(cut(c))


@F.pandas_udf(StringType())
def llm_json(s: pd.Series) -> pd.Series:
    return s.map(last_json)


def clamp(c: Column, fallback: float = 0.5) -> Column:
    number = F.expr("double('NaN')") if c is None else c.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), fallback).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
