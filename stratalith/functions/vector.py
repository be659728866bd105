"""Feature hashing, cosines and pluggable encoders."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalith.functions import text

#: FNV-1a, 32 bits (fixed values).
FNV_START, FNV_PRIME, MASK = 2166136261, 16777619, 4294967295


def fnv32(token: Column) -> Column:
    """Hash over UTF-16 units, which are code points here: tokens hold no others."""
    units = F.transform(F.split(token, ""), lambda ch: F.ascii(ch).cast("bigint"))
    return F.aggregate(F.filter(units, lambda u: u > 0), F.lit(FNV_START).cast("bigint"), lambda h, u: (h.bitwiseXOR(u) * FNV_PRIME).bitwiseAND(F.lit(MASK)))


def hash_slots(tokens: Column, dims: int = 64) -> Column:
    """Array of (slot, sign): slot by the hash modulo ``dims``, sign by its top bit."""
    one = lambda h: F.struct((h % dims).cast("int").alias("slot"), F.when(h.bitwiseAND(F.lit(1 << 31)) == 0, 1).otherwise(-1).alias("sign"))
    return F.transform(F.transform(tokens, fnv32), one)


def feature_hash(c: Column, dims: int = 64) -> Column:
    """Unit vector of signed slot counts, rounded to 6 digits; all zero without tokens."""
    zero = F.array_repeat(F.lit(0.0), dims)
    sums = F.aggregate(hash_slots(text.encoder_tokens(c), dims), zero, lambda a, x: F.transform(a, lambda v, i: v + F.when(i == x["slot"], x["sign"]).otherwise(0)))
    norm = F.aggregate(sums, F.lit(0.0), lambda s, v: s + v * v, F.sqrt)
    return F.aggregate(F.array(F.struct(sums.alias("s"), norm.alias("n"))), zero, lambda _, p: F.transform(p["s"], lambda v: F.when(p["n"] > 0, F.floor(v / p["n"] * 1e6 + 0.5) / 1e6).otherwise(v)))


def dot(a: Column, b: Column) -> Column:
    """In double precision, of arrays of one length; null if a component is."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for null, empty, of unequal length, zero or not finite norm."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0) & (size < float("inf")), dot(a, b) / size).otherwise(0.0)


def child_score(query: Column, query_model: Column, child: Column, child_model: Column) -> Column:
    """Cosine, at least 0, of vectors of the same model and length; else 0."""
    return F.when(query_model == child_model, F.greatest(F.lit(0.0), cosine(query, child))).otherwise(0.0)


@dataclass(frozen=True)
class Encoder:
    """``encode(kind)`` turns a pandas iterator of texts into one of vectors; ``health`` raises if it can't serve."""

    model: str
    dims: int
    encode: Callable[[Iterator[pd.Series], str], Iterator[pd.Series]] | None
    health: Callable[[], None] = lambda: None

    def vectors(self, df: DataFrame, column: str, kind: str = "passage", into: str = "vector") -> DataFrame:
        """Null where the encoder has no vector for a text; such rows can be repaired by running it again on them."""
        if self.encode is None:
            return df.withColumn(into, feature_hash(F.col(column), self.dims) if self.dims else F.lit(None).cast("array<float>"))
        run = self.encode

        def batches(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
            return run(it, kind)

        return df.withColumn(into, F.pandas_udf(batches, "array<float>")(F.col(column)))

    def repair(self, df: DataFrame, column: str, into: str = "vector") -> DataFrame:
        """Vectors for rows that lack one."""
        return df.filter(F.col(into).isNotNull()).unionByName(self.vectors(df.filter(F.col(into).isNull()).drop(into), column, into=into))


def hash_encoder(dims: int = 64) -> Encoder:
    return Encoder(f"feature-hash-{dims}", max(64, dims), None)


def lexical_only() -> Encoder:
    return Encoder("none", 0, None)


def http_encoder(url: str, model: str, revision: str, dims: int, timeout: float = 15.0, batch: int = 32, required: bool = False, post: Callable[[str, dict], dict] | None = None) -> Encoder:
    """A service that takes ``{protocol, model, revision, kind, texts}``; at most 128 texts a request.

    A failure gives null vectors, or ends the job if ``required``.
    """
    size = max(1, min(128, batch))

    def send(path: str, body: dict | None) -> dict:
        if post is not None:
            return post(path, body or {})
        request = urllib.request.Request(url + path, None if body is None else json.dumps(body).encode(), {"content-type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())

    def check(answer: dict, n: int | None = None) -> dict:
        if answer.get("model") != model or answer.get("revision") != revision or answer.get("dimensions") != dims:
            raise ValueError("the service has another model, revision or number of dimensions")
        if n is not None and (len(answer["vectors"]) != n or any(len(v) != dims for v in answer["vectors"])):
            raise ValueError("the service must give one vector of each text")
        return answer

    def encode(it: Iterator[pd.Series], kind: str) -> Iterator[pd.Series]:
        for texts in it:
            out: list = [None] * len(texts)
            rows = [i for i, t in enumerate(texts) if t]
            for lo in range(0, len(rows), size):
                part = rows[lo : lo + size]
                try:
                    answer = check(send("/embed", {"protocol": 1, "model": model, "revision": revision, "kind": kind, "texts": [texts.iloc[i] for i in part]}), len(part))
                    for i, v in zip(part, answer["vectors"]):
                        out[i] = v
                except Exception:
                    if required:
                        raise
            yield pd.Series(out)

    return Encoder(f"{model}@{revision}", dims, encode, lambda: check(send("/health", None)) and None)
