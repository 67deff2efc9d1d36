"""Token ids as binary files in Simple-8b words.

A file row is a chunk of whole documents. Its ids are cut into blocks of ``BLOCK``, each coded by itself: a 64-bit word
has a selector in its upper four bits, which says how many ids of how many bits the other sixty hold. A value too large
for sixty bits is coded as the largest one there, and stands in the chunk's list of escapes. The word offset of every
block is kept, so a block can be read alone and all blocks are decoded at once by shifts of arrays.

Columns of the files: part, chunk, start (ids of the part before the chunk), n_ids, doc_ids and lengths (little-endian 64-bit
integers), words and escapes (little-endian unsigned 64-bit), offsets (little-endian unsigned 32-bit: words before each
block). Parts follow each other in ascending order of document ids, so ids before a part is a sum over smaller parts.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilelake.llm.shared import folder
from tilelake.llm.words import Words, mix, ragged, slices

BLOCK = 128
#: A chunk ends with the document that brings it to this many ids.
CHUNK = 1 << 17
#: Bytes of text of a part of the files, on average.
PART = 64 << 20

#: Fixed values of Simple-8b: ids in a word and bits of each, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
ESCAPE = np.uint64((1 << 60) - 1)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, block offsets and escapes of uint64 values. Each word takes as many of the next values as fit; behind a
    block's end everything fits. The blocks advance together."""
    n = len(values)
    n_blocks = -(-n // BLOCK)
    big = values >= ESCAPE
    escapes = values[big]
    v = np.zeros(n_blocks * BLOCK + 240, np.uint64)
    v[:n] = np.where(big, ESCAPE, values)
    v[n_blocks * BLOCK :] = 0
    size = len(v)
    # how many values from each place on have at most that many bits, for each width in use
    choice = np.full(size, 15, np.int64)
    places = np.arange(size)
    ends = np.minimum((places // BLOCK + 1) * BLOCK, size)
    open_ = np.ones(size, bool)
    for s in range(15):
        wide = np.where(v >> np.uint64(WIDTHS[s]) if WIDTHS[s] else v, places, size)
        following = np.minimum.accumulate(wide[::-1])[::-1]  # the next value that doesn't fit
        fits = open_ & (np.minimum(ends, places + COUNTS[s]) <= following)
        choice[fits] = s
        open_ &= ~fits
    at = np.arange(n_blocks) * BLOCK
    block = np.arange(n_blocks)
    stop = np.minimum(at + BLOCK, n)
    starts, owners = [], []
    while len(at):
        starts.append(at)
        owners.append(block)
        at = at + COUNTS[choice[at]]
        on = at < stop
        at, block, stop = at[on], block[on], stop[on]
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(start, kind="stable")
    start, owner = start[order], owner[order]
    sel = choice[start]
    out = sel.astype(np.uint64) << np.uint64(60)
    limit = np.minimum((owner + 1) * BLOCK, n)
    for s in np.unique(sel):
        if not WIDTHS[s]:
            continue
        mine = np.flatnonzero(sel == s)
        for k in range(COUNTS[s]):
            live = mine[start[mine] + k < limit[mine]]
            if not len(live):
                break
            out[live] |= v[start[live] + k] << np.uint64(WIDTHS[s] * k)
    return out, np.searchsorted(owner, np.arange(n_blocks)).astype(np.uint32), escapes


def unpack(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n values of a chunk. words[offsets[b]:offsets[b + 1]] with n = BLOCK is a block alone."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[sel]
    ends = np.append(offsets[1:], len(words)).astype(np.int64)
    block = np.repeat(np.arange(len(offsets)), ends - offsets)
    before = np.cumsum(count) - count
    inner = before - before[offsets.astype(np.int64)][block] if len(words) else before  # values of the block before the word
    room = np.minimum(BLOCK, n - block * BLOCK)
    count = np.minimum(count, room - inner)
    turn = ragged(np.zeros(len(words), np.int64), count)
    width = np.repeat(WIDTHS[sel], count).astype(np.uint64)
    out = (np.repeat(words, count) >> (width * turn.astype(np.uint64))) & ((np.uint64(1) << width) - np.uint64(1))
    if len(escapes):
        out[out == ESCAPE] = escapes
    return out


#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Tokens:
    """Ids of whole texts by a tokenizer file whose pattern cuts words, digits and runs of symbols and drops white space.

    Each such piece is encoded by the tokenizers library once, and looked up by hash after that, its bytes being compared
    with the kept ones; a text with another piece of the same hash is encoded whole. The table is emptied when it holds
    ``LIMIT`` pieces. Texts of plain characters are cut by byte classes, for a slice of texts at once. The
    pieces of a text depend only on characters there: letters up to U+024F need no normalisation, and neither an
    apostrophe (contractions) nor ``<|`` (special tokens) may occur. Other texts are encoded whole by the library.
    """

    LIMIT = 1 << 20

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.kind = np.full(256, 9, np.uint8)  # 9: not plain
        self.kind[[9, 10, 13, 32]] = 0
        self.kind[33:127] = 3
        self.kind[48:58] = 2
        self.kind[65:91] = self.kind[97:123] = 1
        self.kind[0xC3:0xCA] = self.kind[0x80:0xC0] = 1
        self.kind[39] = 9
        self.rare = regex.compile(rb"\xc3[\x97\xb7]|\xc4\xb0|<\|")
        self.clear()

    def clear(self) -> None:
        self.key, self.slot = np.zeros(1 << 21, np.uint64), np.zeros(1 << 21, np.int64)
        self.index: dict[int, int] = {}
        self.size, self.word, self.rest, self.bytes, self.n_bytes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint8), 0
        self.first, self.length, self.flat, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0

    def _add(self, hashes: list[int], pieces: list[str]) -> None:
        for h, piece, e in zip(hashes, pieces, self.whole.encode_batch(pieces, add_special_tokens=False), strict=True):
            k, ids, raw = len(self.index), e.ids, piece.encode()
            if k >= len(self.first):
                self.first, self.length, self.size, self.word, self.rest = (np.resize(x, 2 * k) for x in (self.first, self.length, self.size, self.word, self.rest))
            if self.used + len(ids) > len(self.flat):
                self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
            self.index[h] = k
            self.first[k], self.length[k] = self.used, len(ids)
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.size[k], self.word[k], self.rest[k] = len(raw), int.from_bytes(raw[:8], "little"), self.n_bytes
            if len(raw) > 8:
                if self.n_bytes + len(raw) > len(self.bytes):
                    self.bytes = np.resize(self.bytes, 2 * (self.n_bytes + len(raw)))
                self.bytes[self.n_bytes : self.n_bytes + len(raw) - 8] = np.frombuffer(raw[8:], np.uint8)
                self.n_bytes += len(raw) - 8

    def _other(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """The pieces whose bytes aren't those of their entries: first eight bytes as one number, then the rest."""
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        size = end - start
        word = np.ndarray(len(data) + 1, np.dtype("<u8"), padded.tobytes(), strides=(1,))[start] & _FIRST[np.minimum(size, 8)]
        bad = (word != self.word[entry]) | (size != self.size[entry])
        long = np.flatnonzero((size > 8) & ~bad)
        more = size[long] - 8
        differ = data[ragged(start[long] + 8, more)] != self.bytes[ragged(self.rest[entry[long]], more)]
        bad[np.repeat(long, more)[differ]] = True
        return np.flatnonzero(bad)

    def _entries(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = mix(Words(data, start, end, np.zeros(0), range(0)).hashes() + (end - start).astype(np.uint64)) | np.uint64(1)
        at = (h >> np.uint64(43)).astype(np.int64)
        entry = self.slot[at]
        miss = np.flatnonzero(self.key[at] != h)
        if len(miss):
            values, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            values = values.tolist()
            new = [k for k, x in enumerate(values) if x not in self.index]
            if new:
                spots = miss[where[new]]
                self._add([values[k] for k in new], [data[start[i] : end[i]].tobytes().decode() for i in spots])
            found = np.array([self.index[x] for x in values], np.int64)
            entry[miss] = found[back]
            self.key[at[miss]], self.slot[at[miss]] = h[miss], found[back]
        return entry

    def encode(self, text: pa.Array):
        """(rows, ids, offsets) for runs of texts, in order."""
        for data, offsets, rows in slices(text):
            if len(self.index) > self.LIMIT:
                self.clear()
            kind = self.kind[data]
            odd = np.concatenate([[0], np.cumsum(kind == 9)])
            other = odd[offsets[1:]] > odd[offsets[:-1]]
            for m in self.rare.finditer(data.tobytes()):
                other[np.searchsorted(offsets, m.start(), "right") - 1] = True
            kind = np.where(np.repeat(other, np.diff(offsets)), 0, kind)
            before = np.zeros(len(kind), np.uint8)
            before[1:] = kind[:-1]
            cuts = offsets[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < len(kind))]
            before[cuts] = 0
            begins = (kind != 0) & ((kind != before) | (kind == 2))
            start = np.flatnonzero(begins)
            # a piece ends where the next begins or white space or a text's end is
            after = np.zeros(len(kind) + 1, bool)
            after[:-1] = begins | (kind == 0)
            after[-1] = True
            after[cuts] = True
            stops = np.flatnonzero(after)
            end = stops[np.searchsorted(stops, start, "right")]
            entry = self._entries(data, start, end)
            wrong = self._other(data, start, end, entry)
            other[np.searchsorted(offsets, start[wrong], "right") - 1] = True
            length = self.length[entry]
            total = np.concatenate([[0], np.cumsum(length)])
            ids, edge = self.flat[ragged(self.first[entry], length)], total[np.searchsorted(start, offsets)]
            if other.any():
                own = [t for t, o in zip(text.slice(rows.start, len(rows)).to_pylist(), other, strict=True) if o]
                extra = iter(self.whole.encode_batch(own, add_special_tokens=False))
                parts = [np.array(next(extra).ids, np.uint32) if o else ids[a:b] for o, a, b in zip(other, edge[:-1], edge[1:], strict=True)]
                ids, edge = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            yield rows, ids, edge


_loaded: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


FILE = "part int, chunk long, start long, n_ids long, doc_ids binary, lengths binary, words binary, offsets binary, escapes binary"


def write_tokens(docs: DataFrame, out: str, path: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 1) -> None:
    """Writes the ids of every whole text, each followed by ``end_id``, to ``out`` in ascending order of doc_id.

    Null text is empty. Documents with equal ids follow each other, ordered by text; null ids come first. The documents
    are dealt to parts by ranges of their ids, as many as the size of the texts asks for, and sorted within, so no task
    holds more than its range, one chunk at a time. Documents of one id are in one part. An empty table writes no chunks.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
    dealt = own.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def chunks(it):
        part, number, start, held = TaskContext.get().partitionId(), 0, 0, [[], [], [], 0]

        def flush():
            nonlocal number, start, held
            ids = np.concatenate(held[2]).astype(np.uint64)
            packed = pack(ids)
            cols = [[part], [number], [start], [len(ids)], [np.concatenate(held[0]).tobytes()], [np.concatenate(held[1]).tobytes()], *[[x.tobytes()] for x in packed]]
            number, start, held = number + 1, start + len(ids), [[], [], [], 0]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in FILE.split(", ")])

        for b in it:
            doc = b.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            for rows, ids, edge in tokens(path).encode(b.column(1)):
                with_end = np.full(len(ids) + len(rows), end_id, np.uint32)
                spot = np.arange(len(ids)) + np.repeat(np.arange(len(rows)), np.diff(edge))
                with_end[spot] = ids
                edge = edge + np.arange(len(rows) + 1)
                at = 0
                while at < len(rows):
                    to = min(len(rows), max(at + 1, int(np.searchsorted(edge, edge[at] + CHUNK - held[3]))))
                    held[0].append(doc[rows.start + at : rows.start + to])
                    held[1].append(np.diff(edge[at : to + 1]).astype(np.int64))
                    held[2].append(with_end[edge[at] : edge[to]])
                    held[3] += int(edge[to] - edge[at])
                    at = to
                    if held[3] >= CHUNK:
                        yield flush()
        if held[0]:
            yield flush()

    dealt.mapInArrow(chunks, FILE).write.parquet(out)


#: Stands for a null doc_id in the files.
NULL_ID = -(1 << 63)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents of token files; start counts the ids of all documents before, ids
    are little-endian unsigned 32-bit integers. Ids before each part: a running sum over one row for each part."""
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids binary", lambda ids, edge: pa.array([ids[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()), "ids")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents of token files."""
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids, edge: pa.array([zlib.crc32(ids[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.int64()), "ids_crc32")


def _read(spark: SparkSession, path: str, schema: str, make, name: str) -> DataFrame:
    files = spark.read.schema(FILE).parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))

    def docs(it):
        for b in it:
            cols = {k: b.column(k) for k in b.schema.names}
            for k in range(b.num_rows):
                get = lambda c, t: np.frombuffer(cols[c][k].as_py(), t)  # noqa: B023, E731
                lengths = get("lengths", np.int64)
                edge = np.concatenate([[0], np.cumsum(lengths)])
                ids = unpack(get("words", np.uint64), get("offsets", np.uint32), get("escapes", np.uint64), int(edge[-1])).astype(np.uint32)
                doc, start = get("doc_ids", np.int64), cols["part_start"][k].as_py() + cols["start"][k].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == NULL_ID), pa.array(start + edge[:-1]), pa.array(lengths), make(ids, edge)], names=["doc_id", "start", "n_tokens", name])

    return files.join(offsets, "part").select("start", "part_start", "doc_ids", "lengths", "words", "offsets", "escapes").mapInArrow(docs, schema)


def op10_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), out, public_tokenizers.path("word_bpe_49k.json"))
    return read_digests(spark, out)
