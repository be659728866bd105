"""Oversized texts cut at natural boundaries by recursive bisection.

A text over the limit is cut at the strongest boundary near its midpoint; halves over the limit less the overlap are cut
again; at last every piece but the first takes the end of the text before it as overlap. A cut or the start of an overlap
lies within a word only where there is no boundary at all. Positions are code points, so
the cores of the pieces, put together, are the text again.
"""

from __future__ import annotations

import re
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP, PREVIEW = 512, 64, 240

#: Kinds of boundary, strongest first; a piece may end where a match ends.
BOUNDARIES = [
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"\n(?=\s*(?:[-*+•]|\d+[.)]|#{1,6}|```)\s)\s*|\n"),
    re.compile(r"[.!?][\"'”’)\]]*\s+|[。！？][”’」』）]*"),
    re.compile(r"[;:,]\s+|[；：，、]"),
    re.compile(r"\s+"),
]


def prefix_tokens(text: str) -> np.ndarray:
    """``out[i]`` makes the size of any span quick: see :func:`span_tokens`. Non-ASCII code points so far."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes > 127


def token_count(wide: np.ndarray) -> int:
    """Tokens of a span, given which of its code points aren't ASCII: one for each of these, ceil(n / 4) a run of ASCII."""
    n = len(wide)
    if not n:
        return 0
    at = np.flatnonzero(wide)
    if not len(at):
        return (n + 3) // 4
    runs = np.diff(np.concatenate([[-1], at, [n]])) - 1
    return len(at) + int(((runs + 3) // 4).sum())


def tail(wide: np.ndarray, end: int, tokens: int) -> int:
    """The least start from which ``[start, end)`` holds at most ``tokens`` tokens."""
    low, high = max(0, end - 4 * tokens), end
    while low < high:
        mid = (low + high) // 2
        if token_count(wide[mid:end]) <= tokens:
            high = mid
        else:
            low = mid + 1
    return low


def split_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces (start of overlap, start of core, end) of a text; one piece if it is within the limit."""
    wide = prefix_tokens(text)
    n = len(wide)
    if token_count(wide) <= limit:
        return [(0, 0, n)]
    marks = [np.fromiter((m.end() for m in kind.finditer(text)), np.int64) for kind in BOUNDARIES]
    cores, todo = [], [(0, n)]
    while todo:
        a, b = todo.pop()
        if token_count(wide[a:b]) <= limit - overlap or b - a < 2:
            cores.append((a, b))
            continue
        mid = (a + b) // 2
        cut = mid
        # The middle half of the span counts as near the midpoint; a boundary there leaves both parts clearly smaller. The
        # rest of the span is searched only if no kind of boundary lies there.
        for near, at in product((max(1, (b - a) // 4), b - a), marks):
            i = np.searchsorted(at, mid)
            best = [p for p in at[max(0, i - 1) : i + 1] if a < p < b and abs(p - mid) <= near]
            if best:
                cut = int(min(best, key=lambda p: abs(p - mid)))
                break
        todo += [(cut, b), (a, cut)]
    edges = np.unique(np.concatenate(marks))
    out = []
    for a, b in cores:
        start = a
        if a and overlap:
            start = tail(wide, a, overlap)
            i = np.searchsorted(edges, start)
            if i < len(edges) and edges[i] < a:
                start = int(edges[i])
            while token_count(wide[start:b]) > limit:  # only a core of one code point can leave so little room
                start += 1
        out.append((start, a, b))
    return out


PIECES = [("piece_no", T.IntegerType()), ("n_pieces", T.IntegerType()), ("start_offset", T.IntegerType()), ("end_offset", T.IntegerType()), ("overlap_tokens", T.IntegerType()), ("token_count", T.IntegerType()), ("embedding_text_preview", T.StringType()), ("piece_text", T.StringType())]


def pieces(texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, whole: bool = False) -> DataFrame:
    """``id`` and, for each piece, ``piece_no, n_pieces, start_offset, end_offset, overlap_tokens, token_count,
    embedding_text_preview, piece_text``.

    ``texts`` has ``id`` (bigint), ``title`` and ``text``. Offsets are code points of the piece's core, end exclusive, as
    the children have them: cores follow one another without gap. ``piece_text`` is the overlap with the text before and
    the core, of ``token_count`` tokens, at most ``limit``; the overlap has ``overlap_tokens``, at most ``overlap``. The
    preview is title, overlap and core by lines, cut at 240. Texts within the limit give a row only if ``whole``; null
    and empty texts give none. Repeated rows give repeated pieces.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    schema = T.StructType([T.StructField("id", T.LongType()), *(T.StructField(n, t) for n, t in PIECES)])
    rows = texts.select(F.col("id").cast("bigint").alias("id"), F.col("title").cast("string").alias("title"), "text")
    # One token needs at least one code point, so shorter texts can't exceed the limit and never leave the JVM.
    rows = rows.filter(F.length("text") > (0 if whole else limit))

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for key, title, text in zip(*(batch.column(i) for i in range(3))):
                text, key, title = text.as_py(), key.as_py(), title.as_py()
                cut = split_points(text, limit, overlap)
                if len(cut) == 1 and not whole:
                    continue
                wide = prefix_tokens(text)
                for i, (start, a, b) in enumerate(cut):
                    preview = "\n".join(x for x in (title, text[start:a].strip(), text[a:b].strip()) if x)[:PREVIEW]
                    out.append((key, i, len(cut), a, b, token_count(wide[start:a]), token_count(wide[start:b]), preview, text[start:b]))
                size += len(text)
                if size > 4_000_000:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    arrow = pa.schema([("id", pa.int64()), *((n, pa.string() if isinstance(t, T.StringType) else pa.int32()) for n, t in PIECES)])

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)
