"""Exact building blocks for joins by edit distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

#: Characters counted in a signature: fixed values, eight to each of two longs.
COUNTED = ("cnos(=[1", "flb2#@-+")


def signature(text: Column) -> list[Column]:
    """Two longs that hold, byte by byte, how often each counted character occurs (at most 255)."""
    out = []
    for chars in COUNTED:
        packed = F.lit(0).cast("long")
        for place, char in enumerate(chars):
            n = F.least(F.length(text) - F.length(F.replace(text, F.lit(char), F.lit(""))), F.lit(255)).cast("long")
            packed = packed.bitwiseOR(F.shiftleft(n, 8 * place))
        out.append(packed)
    return out


def signature_distance(a: list[Column], b: list[Column]) -> Column:
    """Sum of differences of counts: one edit changes it by at most 2."""
    total = F.lit(0).cast("long")
    for x, y in zip(a, b, strict=True):
        for place in range(0, 64, 8):
            counter = lambda v, p=place: F.shiftrightunsigned(v, p).bitwiseAND(F.lit(255).cast("long"))
            total = total + F.abs(counter(x) - counter(y))
    return total


#: Classes that pairs of successive characters are hashed into; each has one bit in each of four longs.
PAIR_CLASSES = 64


@F.pandas_udf(ArrayType(LongType()))
def pair_signature(texts: pd.Series) -> pd.Series:
    """How often each class of successive characters occurs, up to 4, in unary: bit c of long i says "more than i times".

    Counting every pair of a batch at once in NumPy takes a hundredth of what nested array functions do.
    """
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for t in texts]
    sizes = np.array([max(0, len(c) - 1) for c in codes], np.int64)
    firsts = np.concatenate([np.zeros(0, np.int64), *(c[:-1] for c in codes)])
    seconds = np.concatenate([np.zeros(0, np.int64), *(c[1:] for c in codes)])
    classes = ((firsts * 2654435761 + seconds * 40503) >> 7) % PAIR_CLASSES
    counts = np.bincount(np.repeat(np.arange(len(codes)), sizes) * PAIR_CLASSES + classes, minlength=len(codes) * PAIR_CLASSES)
    unary = counts.reshape(len(codes), 1, PAIR_CLASSES) > np.arange(4).reshape(1, 4, 1)
    return pd.Series(list(np.packbits(unary, axis=2, bitorder="little").view("<i8")[:, :, 0]))


def pair_distance(a: list[Column], b: list[Column]) -> Column:
    """Sum of differences of the counts: one edit changes it by at most 4 (a replacement undoes two pairs and makes two).

    In unary the differences are the bits in which two longs differ, so a comparison is four machine instructions; a
    condition with a term for every counter grows beyond what the JVM compiles.
    """
    total = F.lit(0)
    for x, y in zip(a, b, strict=True):
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total


def within(a: Column, b: Column, k: int) -> Column:
    """Whether the edit distance is at most k (dynamic programming in a band of 2 k + 1 diagonals)."""
    return F.levenshtein(a, b, k) >= 0


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Characters of a batch that are hashed at once.
_CELLS = 1 << 18


def _mixed(h: np.ndarray, *numbers: int) -> np.ndarray:
    """A hash of substrings with the numbers of their place, spread over all 64 bits."""
    for n in numbers:
        h = (h ^ np.uint64(n & 0xFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
    return h


class Windows:
    """Hashes of substrings of equally long texts: sums of codes times powers, so that any window is one subtraction."""

    def __init__(self, texts: list[str], length: int):
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), length)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(length, np.uint64(_BASE))]))
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(length, np.uint64(_INVERSE))]))
        self.sums = np.zeros((len(texts), length + 1), np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[:length], axis=1, out=self.sums[:, 1:])

    def at(self, start: int, size: int) -> np.ndarray:
        return (self.sums[:, start + size] - self.sums[:, start]) * self.back[start]


def keys_by_length(texts: pd.Series, lengths: np.ndarray, places) -> pd.Series:
    """Arrays of hashes for the first `lengths` characters of each text; `places(length)` lists (start, size, *marks)."""
    out: list[np.ndarray | None] = [None] * len(texts)
    values = texts.tolist()
    order = np.argsort(lengths, kind="stable")
    ends = np.flatnonzero(np.diff(lengths[order], append=-1)) + 1
    begin = 0
    for end in ends.tolist():
        rows, length = order[begin:end], int(lengths[order[begin]])
        begin = end
        wanted = list(places(length))
        step = max(1, _CELLS // max(1, length))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            windows = Windows([values[r][:length] for r in part], length)
            keys = np.stack([_mixed(windows.at(start, size), *marks) for start, size, *marks in wanted], axis=1) if wanted else np.zeros((len(part), 0), np.uint64)
            for r, row in zip(part.tolist(), keys.view(np.int64), strict=True):
                out[r] = row
    return pd.Series(out, index=texts.index, dtype=object)


def segment(length: int, i: int, k: int) -> tuple[int, int]:
    """Start (from 0) and length of the i-th of k + 1 segments, as even as possible, the longer ones last."""
    base, short = length // (k + 1), k + 1 - length % (k + 1)
    return i * base + max(0, i - short), base + (i >= short)


def _segments(length: int, k: int):
    for i in range(k + 1):
        yield (*segment(length, i, k), length, i)


def _substrings(length: int, k: int):
    for other in range(max(1, length - k), length + k + 1):
        shift = length - other
        for i in range(k + 1):
            start, size = segment(other, i, k)
            low = max(0, start - i, start + shift - (k - i))
            for p in range(low, min(length - size, start + i, start + shift + (k - i)) + 1):
                yield p, size, other, i


def _keys(places, k: int):
    @F.pandas_udf(ArrayType(LongType()))
    def run(texts: pd.Series) -> pd.Series:
        return keys_by_length(texts, texts.str.len().to_numpy(np.int64), lambda length: places(length, k))

    return run


def segment_keys(text: Column, k: int) -> Column:
    """Hashes of the k + 1 segments of a text, each with the text's length and the segment's number."""
    return _keys(_segments, k)(text)


def substring_keys(text: Column, k: int) -> Column:
    """Hashes of all substrings that can equal a segment of a text at most k edits away.

    For each possible length of the other text and each segment, the positions are those that both the view from the
    left (at most i edits before the segment) and from the right (at most k - i edits after it) allow. All windows of
    a batch's texts of one length are hashed at once; equal windows have equal hashes, and others are told apart by
    the comparison that follows.
    """
    return _keys(_substrings, k)(text)
