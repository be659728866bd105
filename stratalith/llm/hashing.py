"""Word values and rolling hashes over whole batches of texts, vectorised over all positions."""

from __future__ import annotations

import numpy as np
import xxhash

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


class WordValues(dict):
    """Word -> 64-bit value, the same in every process. Forgets all words at a size, so that memory stays bounded."""

    limit = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shifted(a: np.ndarray, n: int) -> np.ndarray:
    """``a[i + n]`` at ``i``, zero beyond the end."""
    out = np.zeros_like(a)
    if n < len(a):
        out[: len(a) - n] = a[n:]
    return out


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def rolling(values: np.ndarray, k: int, base: np.uint64 = MIX[0]) -> np.ndarray:
    """Polynomial hash modulo 2**64 of the ``k`` values that begin at each position, by doubling."""
    with np.errstate(over="ignore"):
        out, done, part, size = None, 0, values, 1
        while k:
            if k & 1:
                out = part.copy() if out is None else out * _power(base, size) + shifted(part, done)
                done += size
            k >>= 1
            if k:
                part = part * _power(base, size) + shifted(part, size)
                size *= 2
        out ^= out >> np.uint64(29)
        out *= MIX[1]
        return out ^ (out >> np.uint64(32))


def sliding(a: np.ndarray, w: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over ``a[i : i + w]``; only positions with a whole window are meaningful."""
    part, size = a, 1
    while size * 2 <= w:
        part, size = pick(part, shifted(part, size)), size * 2
    return pick(part, shifted(part, w - size)) if size < w else part
