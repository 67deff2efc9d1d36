"""Vectorised words of Arrow string batches, shared by the operators that work on word sequences.

A batch is cut into slices of whole documents of about ``SLICE`` bytes, so the numpy arrays made for a slice stay small
whatever the batch holds; a document longer than a slice is a slice of its own. Words are runs of bytes of a class, so
that a UTF-8 text needs no decoding: every byte of a character outside ASCII is 0x80 or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = 1 << 20

#: The word class ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_MULT, _INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of consecutive documents. ``first[d]`` is the index of the first word of document d, with a last entry."""

    data: np.ndarray  # lower-cased bytes of the slice
    start: np.ndarray  # byte offset of each word
    end: np.ndarray
    first: np.ndarray
    rows: range  # rows of the batch

    @property
    def n(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not self.n:
            return np.zeros(0, np.uint64)
        up, down = _power(len(self.data) + 1)
        total = np.empty(len(self.data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_VALUE[self.data] * up[:-1], dtype=np.uint64, out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])

    def doc(self) -> np.ndarray:
        """The document (counted within the slice) of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; null is empty."""
    if text.null_count:
        text = text.fill_null("")
    big = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    offsets = np.frombuffer(text.buffers()[1], np.int64 if big else np.int32)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets.astype(np.int64)


def slices(text: pa.Array, limit: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, range]]:
    """Bytes, offsets from 0 and rows of runs of whole documents of at most ``limit`` bytes (or one document)."""
    if not len(text):
        return
    data, offsets = buffers(text)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], range(at, to)
        at = to


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values, cut at document boundaries."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    before[cuts] = False
    after[cuts - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(text: pa.Array, limit: int = SLICE) -> Iterator[Words]:
    """The words ``WORD`` of every document, in slices."""
    for data, offsets, rows in slices(text, limit):
        low = _LOWER[data]
        start, end = runs(IS_WORD[low], offsets)
        yield Words(low, start, end, np.searchsorted(start, offsets), rows)


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words and the index of their first word; runs don't cross documents. A document of fewer
    words, but not none, has one run of all its words."""
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    length = np.diff(first)
    left = np.repeat(first[1:], length) - np.arange(len(h))  # words from here to the document's end
    whole = np.flatnonzero(left >= n)
    g = np.zeros(len(whole), np.uint64)
    for k in range(n):
        g = mix(g + h[whole + k])
    short = np.flatnonzero((length > 0) & (length < n))
    if not len(short):
        return g, whole
    s = np.zeros(len(short), np.uint64)
    for k in range(n - 1):
        there = length[short] > k
        s[there] = mix(s[there] + h[first[short][there] + k])
    at = np.concatenate([whole, first[short]])
    order = np.argsort(at, kind="stable")
    return np.concatenate([g, mix(s + length[short].astype(np.uint64))])[order], at[order]


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + length[i] - 1, one range after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)


def attach(docs: DataFrame, out: str, kind: T.DataType, fn) -> DataFrame:
    """docs with a column ``out`` (replaced if there is one) that ``fn`` (Arrow table of a batch → Arrow array) makes."""
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, kind)])

    def batches(it):
        for b in it:
            made = fn(b)
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, out])

    return docs.mapInArrow(batches, schema)


def words_of(text: Column) -> Column:
    """The words ``WORD`` of a text column, null as empty, as a built-in expression."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(f"({WORD})"), F.lit(1))
