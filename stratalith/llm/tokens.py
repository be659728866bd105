"""Sizes of texts in tokens of a public tokenizer. The vocabulary's path is a parameter; the file is read on executors."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: How the tokenizer cuts a text before merging (fixed value, public with the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding(path.rsplit("/", 1)[-1], pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with its text replaced by ``n_tokens``. Rows with a null or blank text are left out."""
    keep = [f for f in df.schema if f.name != text]
    at = [df.columns.index(f.name) for f in keep]
    text_at = df.columns.index(text)
    schema = T.StructType([*keep, T.StructField("n_tokens", T.LongType())])

    def run(batches):
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            texts = batch.column(text_at)
            n = pa.array([len(encode(t)) if t is not None and t.strip() else None for t in (x.as_py() for x in texts)], pa.int64())
            columns = [*(batch.column(i) for i in at), n]
            out = pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in keep), "n_tokens"])
            yield out.filter(n.is_valid())

    return df.mapInArrow(run, schema)
