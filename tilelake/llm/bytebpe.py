"""Byte-level BPE by monoid tree reduction.

Matches of the pattern are encoded by themselves, so the ids of a text are those of its matches one after another. Within
a match the bytes are halved until a part is a token, at the latest a byte; the ids of neighbouring parts are joined. A join
encodes a window around the cut anew, which grows by tokens on either side until it is stable.

When a window is stable can be told from its ends. Merging by ranks gives each string one encoding, and a sequence of
tokens is the encoding of its bytes if and only if each two tokens that follow each other are the encoding of theirs: a
merge over a boundary that would come first in the whole would also come first in the two. All pairs inside the parts and
inside the window are right, so only the two pairs at the window's ends are looked at; what lies outside is final.

Texts repeat their matches, so those of a worker are kept in a table that is emptied when it is full. Decoding concatenates
the bytes of the tokens up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tilelake.llm.words import attach

#: Bytes up to which the pairs of a window are looked through at each merge; those of a longer one are kept in a heap.
#: Parts of as many bytes are kept.
SHORT = 16
NONE = 1 << 62
#: Matches that a worker keeps, and the longest match that it keeps, in characters.
KEPT, KEPT_LENGTH = 1 << 18, 64
#: Parts of matches, and pairs of tokens, that a worker keeps.
PARTS = 1 << 17

ENCODED = T.StructType([T.StructField("ids", T.BinaryType(), False), T.StructField("n_tokens", T.LongType(), False)])


class Codec(dict):
    """Encodes and decodes whole texts by a rank file. As a dict: the ids of matches."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {v: k for k, v in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.pairs: dict[tuple[int, int], list[int]] = {}
        self.parts: dict[bytes, list[int]] = {}

    def __missing__(self, match: str) -> list[int]:
        ids = self.reduced(match.encode())
        if len(match) <= KEPT_LENGTH:
            self[match] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if len(self) > KEPT:
            self.clear()
        for kept in (self.pairs, self.parts):
            if len(kept) > PARTS:
                kept.clear()
        matches = self.pattern.findall(text) if not self.pattern.groups else [m.group() for m in self.pattern.finditer(text)]
        return list(chain.from_iterable(map(self.__getitem__, matches)))

    def reduced(self, b: bytes) -> list[int]:
        """The encoding of the bytes of a match or of a part of one."""
        if (whole := self.ranks.get(b)) is not None:
            return [whole]
        if (known := self.parts.get(b)) is not None:
            return known
        ids = self.joined(self.reduced(b[: len(b) // 2]), self.reduced(b[len(b) // 2 :]))
        if len(b) <= SHORT:
            self.parts[b] = ids
        return ids

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings."""
        window = self.pair(left[-1], right[0])
        if not window:
            return left + right
        i = j = 1
        while True:
            low = i >= len(left) or not self.pair(left[-i - 1], window[0])
            high = j >= len(right) or not self.pair(window[-1], right[j])
            if low and high:
                return left[:-i] + window + right[j:]
            i, j = min(len(left), i if low else 2 * i), min(len(right), j if high else 2 * j)
            window = self.merged(b"".join(map(self.token.__getitem__, left[-i:] + right[:j])))

    def pair(self, a: int, b: int) -> list[int]:
        """The encoding of the bytes of two tokens; empty if it is the two."""
        if (known := self.pairs.get((a, b))) is None:
            both = self.token[a] + self.token[b]
            one = self.ranks.get(both)
            ids = [one] if one is not None else self.merged(both)
            known = self.pairs[a, b] = [] if ids == [a, b] else ids
        return known

    def merged(self, b: bytes) -> list[int]:
        """The encoding of a string by merging alone: of the neighbours whose union has the least rank, the leftmost become one."""
        n = len(b)
        if n <= SHORT:
            parts, rank = [b[i : i + 1] for i in range(n)], self.ranks.get
            of = [rank(b[i : i + 2], NONE) for i in range(n - 1)]  # ranks of the unions of neighbours
            while of and (least := min(of)) < NONE:
                at = of.index(least)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                del of[at]
                if at:
                    of[at - 1] = rank(parts[at - 1] + parts[at], NONE)
                if at < len(of):
                    of[at] = rank(parts[at] + parts[at + 1], NONE)
            return [self.ranks[x] for x in parts]
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        found = [(r, i, i + 2) for i in range(n - 1) if (r := self.ranks.get(b[i : i + 2])) is not None]
        heapq.heapify(found)
        while found:
            r, i, stop = heapq.heappop(found)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue  # one of the two has grown since
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := self.ranks.get(b[i : end[stop]])) is not None:
                    heapq.heappush(found, (r, i, end[stop]))
            if before[i] >= 0 and (r := self.ranks.get(b[before[i] : stop])) is not None:
                heapq.heappush(found, (r, before[i], stop))
        return [self.ranks[b[i : end[i]]] for i in range(n) if alive[i]]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 1 << 16:
            return b"".join(map(self.token.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each rank file in a worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, *, text: str = "text", out: str = "tokens") -> DataFrame:
    """docs with a struct ``out``: ids (little-endian unsigned 32-bit integers) and n_tokens.

    Each match of the pattern in the whole text is encoded separately by the ranks in ``path``, without special tokens.
    Null or empty text has no ids. Rows are encoded one by one, repeated ones too. Nothing is shuffled; a task holds one
    batch of rows. A column of docs named ``out`` is replaced.
    """

    def one(b: pa.RecordBatch) -> pa.Array:
        c = codec(path)
        made = [np.array(c.encode(t or ""), np.uint32) for t in _strings(b.column(b.schema.names.index(text)))]
        return pa.StructArray.from_arrays([pa.array([x.tobytes() for x in made], pa.binary()), pa.array([len(x) for x in made], pa.int64())], names=["ids", "n_tokens"])

    return attach(docs, out, ENCODED, one)


def decode(docs: DataFrame, path: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with a binary column ``out``: the bytes of the tokens in the binary column ``ids``; null ids: no bytes."""

    def one(b: pa.RecordBatch) -> pa.Array:
        c = codec(path)
        return pa.array([c.decode(np.frombuffer(x, np.uint32).tolist()) if x else b"" for x in (v.as_py() for v in b.column(b.schema.names.index(ids)))], pa.binary())

    return attach(docs, out, T.BinaryType(), one)


def _strings(column: pa.Array):
    return (v.as_py() for v in column)


DIGEST = T.StructType([T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_sha256", T.StringType(), False), T.StructField("decoded_sha256", T.StringType(), False)])


def digest(docs: DataFrame, path: str, *, text: str = "text", out: str = "tokens") -> DataFrame:
    """docs with a struct ``out``: the number of ids and the SHA-256 of the decimal ids and of the decoded bytes. The ids
    are made and decoded as in ``encode`` and ``decode`` but don't leave the task."""

    def one(b: pa.RecordBatch) -> pa.Array:
        c, decimal, made = codec(path), _decimal, []
        for t in _strings(b.column(b.schema.names.index(text))):
            ids = c.encode(t or "")
            made.append((len(ids), hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
        n, a, d = zip(*made, strict=True) if made else ([], [], [])
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return attach(docs, out, DIGEST, one)


class _Decimal(dict):
    def __missing__(self, k: int) -> str:
        self[k] = s = str(k)
        return s


_decimal = _Decimal()


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).select("doc_id", "tokens.*")
