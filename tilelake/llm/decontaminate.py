"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items: ``window`` consecutive words, or the whole of a shorter item.
Patterns of one length form a class with its own tables, so a short item doesn't shorten the skips of the others. A
block is the last ``BLOCK`` words before a cursor. The shift table, indexed by bits of the block's hash, says how far the
cursor may jump without passing the end of an occurrence; it has at least eight places for each block that is in it.
Where it says 0, the bucket of patterns that end in this block is looked up by the block's full hash, the pattern in it by
a hash of the window, and each candidate is compared byte by byte.

Cursors of many stretches of text move in step, as numpy arrays. A document is one row of one task; nothing is
shuffled. Items travel to the tasks in blocks of at most ``block_bytes`` of text, with tables of some 100 bytes a word.
There is one job over the documents for each block; each but the last writes what it found, so a task has the tables of
one block only, whatever the benchmark's size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilelake.llm.shared import written
from tilelake.llm.words import Words, mix, ragged, words

BLOCK = 3
STRETCH = 64
#: Elements of arrays that are made at once from lists of lists.
PIECE = 1 << 20

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])), False),
        T.StructField("items", T.ArrayType(T.StringType()), False),
    ]
)


@dataclass
class Table:
    """The patterns of one length m, in order of their windows' hashes."""

    m: int
    begin: np.ndarray  # first word of each pattern among the items' words
    window: np.ndarray  # hash of each
    item_first: np.ndarray  # items of pattern p: item[item_first[p]:item_first[p + 1]]
    item: np.ndarray
    shift: np.ndarray
    suffix: np.ndarray  # sorted distinct block hashes at a pattern's end


@dataclass
class Patterns:
    ids: list[str]
    words: Words
    tables: list[Table]


def _block(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The hash of the block of words that ends at each index."""
    g = np.zeros(len(at), np.uint64)
    for k in range(size - 1, -1, -1):
        g = mix(g + h[at - k])
    return g


def _slot(g: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(65 - len(table).bit_length())).astype(np.int64)


def _pieces(length: np.ndarray):
    """(list, place in it) of the elements of lists of these lengths, at most PIECE at once."""
    ends = np.cumsum(length)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, PIECE):
        k = np.arange(lo, min(lo + PIECE, int(ends[-1])))
        owner = np.searchsorted(ends, k, "right")
        yield owner, k - (ends[owner] - length[owner])


def equal_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray, m: int) -> np.ndarray:
    """Whether the m words from i of a are those from j of b, by their bytes."""
    same = np.ones(len(i), bool)
    for k in range(m):
        ok = np.flatnonzero(same)
        length = a.end[i[ok] + k] - a.start[i[ok] + k]
        fits = b.end[j[ok] + k] - b.start[j[ok] + k] == length
        same[ok[~fits]] = False
        ok, length = ok[fits], length[fits]
        for owner, at in _pieces(length):
            equal = a.data[a.start[i[ok[owner]] + k] + at] == b.data[b.start[j[ok[owner]] + k] + at]
            same[ok[owner[~equal]]] = False
    return same


def tables(items: list[tuple[str, str]], window: int) -> Patterns:
    """items: (id, text). Items without words have no patterns."""
    w = next(words(pa.array([t for _, t in items], pa.large_string()), limit=1 << 62), None)
    if w is None or not w.n:
        return Patterns([], Words(*[np.zeros(0, np.int64)] * 4, range(0)), [])
    h, n = w.hashes(), np.diff(w.first)
    out = []
    for m in sorted(set(np.minimum(n, window).tolist()) - {0}, reverse=True):
        mine = np.flatnonzero(np.minimum(n, window) == m)
        count = n[mine] - m + 1
        begin, owner = ragged(w.first[mine], count), np.repeat(mine, count)
        g = _block(h, begin + m - 1, m)
        order = np.argsort(g, kind="stable")
        begin, owner, g = begin[order], owner[order], g[order]
        # equal windows are one pattern; among equal hashes there may be several
        pattern, todo = np.full(len(g), -1), np.arange(len(g))
        while len(todo):
            head = np.ones(len(todo), bool)
            head[1:] = g[todo][1:] != g[todo][:-1]
            first = todo[np.flatnonzero(head)[np.cumsum(head) - 1]]
            same = equal_words(w, begin[todo], w, begin[first], m)
            pattern[todo[same]] = first[same]
            todo = todo[~same]
        heads, pattern = np.unique(pattern, return_inverse=True)
        pairs = np.unique(pattern * len(items) + owner)
        begin, g = begin[heads], g[heads]
        size = min(BLOCK, m)
        ends = [_block(h, begin + end, size) for end in range(size - 1, m)]
        shift = np.full(1 << max(10, int(8 * len(np.unique(np.concatenate(ends)))).bit_length()), min(255, m - size + 1), np.uint8)
        for end, block in zip(range(size - 1, m), ends, strict=True):
            np.minimum.at(shift, _slot(block, shift), np.uint8(min(255, m - 1 - end)))
        out.append(Table(m, begin.astype(np.int32), g, np.searchsorted(pairs, np.arange(len(heads) + 1) * len(items)), (pairs % len(items)).astype(np.int32), shift, np.unique(ends[-1])))
    small = Words(w.data, w.start.astype(np.int32), w.end.astype(np.int32), w.first, w.rows)
    return Patterns([i for i, _ in items], small, out)


def search(p: Patterns, t: Table, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and patterns of all occurrences of a table's patterns."""
    m, size = t.m, min(BLOCK, t.m)
    lo, hi = w.first[:-1] + m - 1, w.first[1:]  # a window may end at lo .. hi - 1
    n = np.maximum(0, -((lo - hi) // STRETCH))
    n[hi <= lo] = 0
    at = ragged(np.zeros(len(n), np.int64), n) * STRETCH + np.repeat(lo, n)
    stop = np.minimum(at + STRETCH, np.repeat(hi, n))
    hits = []
    while len(at):
        g = _block(h, at, size)
        jump = t.shift[_slot(g, t.shift)].astype(np.int64)
        zero = jump == 0
        if zero.any():
            hits.append((at[zero], g[zero]))
        at = at + np.maximum(jump, 1)
        live = at < stop
        at, stop = at[live], stop[live]
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends, g = np.concatenate([x[0] for x in hits]), np.concatenate([x[1] for x in hits])
    k = np.minimum(np.searchsorted(t.suffix, g), len(t.suffix) - 1)
    ends = ends[t.suffix[k] == g]
    g = _block(h, ends, m)
    first = np.searchsorted(t.window, g)
    length = np.searchsorted(t.window, g, "right") - first
    begins, patterns = [], []
    for owner, inner in _pieces(length):
        begin, pattern = ends[owner] - m + 1, first[owner] + inner
        same = equal_words(w, begin, p.words, t.begin[pattern], m)
        begins.append(begin[same])
        patterns.append(pattern[same])
    return (np.concatenate(begins), np.concatenate(patterns)) if begins else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _owners(t: Table, doc: np.ndarray, pattern: np.ndarray, n_items: int) -> np.ndarray:
    """doc * n_items + item of the items of the patterns found in documents, each once."""
    pair = np.unique(doc * len(t.begin) + pattern)
    doc, pattern = pair // len(t.begin), pair % len(t.begin)
    first = t.item_first[pattern]
    found = [np.unique(doc[owner] * n_items + t.item[first[owner] + inner]) for owner, inner in _pieces(t.item_first[pattern + 1] - first)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _pass(docs: DataFrame, text: str, out: str, items: list[tuple[str, str]], window: int, n_before: bool) -> DataFrame:
    """One pass over the documents with one block of items, adding to what the passes before found."""
    shared = docs.sparkSession.sparkContext.broadcast(tables(items, window))
    base = docs.drop(out) if not n_before else docs
    schema = T.StructType([*[f for f in base.schema.fields if f.name != out], T.StructField(out, FOUND)])

    def batches(it):
        p = shared.value
        ids = p.ids
        for b in it:
            before = b.column(b.schema.names.index(out)).to_pylist() if n_before else [None] * b.num_rows
            made = []
            for w in words(b.column(b.schema.names.index(text))):
                h, n = w.hashes(), np.diff(w.first)
                cover, found = np.zeros(w.n + 1, np.int64), [np.zeros(0, np.int64)]
                for t in p.tables:
                    begin, pattern = search(p, t, w, h)
                    np.add.at(cover, begin, 1)
                    np.add.at(cover, begin + t.m, -1)
                    found.append(_owners(t, np.searchsorted(w.first, begin, "right") - 1, pattern, len(ids)))
                hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
                doc = np.searchsorted(w.first, hit, "right") - 1
                pairs = np.unique(np.concatenate(found))
                edge = np.searchsorted(pairs, np.arange(len(n) + 1) * len(ids))
                hit_edge = np.searchsorted(doc, np.arange(len(n) + 1))
                for d in range(len(n)):
                    at = hit[hit_edge[d] : hit_edge[d + 1]] - w.first[d]
                    brk = np.flatnonzero(np.diff(at) > 1)
                    spans = list(zip(at[np.append(0, brk + 1)].tolist(), (at[np.append(brk, len(at) - 1)] + 1).tolist(), strict=True)) if len(at) else []
                    got = [ids[k] for k in (pairs[edge[d] : edge[d + 1]] % len(ids)).tolist()]
                    if old := before[w.rows[d]]:
                        spans = _union(spans, [(s["start"], s["end"]) for s in old["spans"]])
                        got = [*got, *old["items"]]
                    made.append({"n_words": int(n[d]), "spans": [{"start": s, "end": e} for s, e in spans], "items": sorted(set(got))})
            kept = [(c, x) for c, x in zip(b.columns, b.schema.names, strict=True) if x != out]
            kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_arrays([*[c for c, _ in kept], pa.array(made, kind)], names=[*[x for _, x in kept], out])

    return base.mapInArrow(batches, schema)


def _union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, out: str = "benchmark_found", block_bytes: int = 8 << 20
) -> DataFrame:
    """docs with a struct ``out`` (n_words; spans of hit words, ends exclusive; ids of the items with occurring windows).

    Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. An item's windows are its runs of ``window``
    words; an item of fewer words, but not none, is one window. A word inside any occurrence of a window is hit. Every
    row of docs is judged by itself, repeated rows too. Null or empty text: no words, no hits. Items that are null or
    have no words match nothing; items with a null id are left out; ids are compared as strings, and rows that repeat an
    id add windows to the same item. An empty benchmark hits nothing. A column of docs named ``out`` is replaced.

    The items come to the driver in blocks of about ``block_bytes`` (at least one item). Each block is one more narrow pass
    over docs; the passes before the last write docs with what they found to the shared folder.
    """
    own = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    size = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    found = docs
    for k in range(n):
        block = own.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        found = _pass(found, text, out, [(r.i, r.t) for r in block.toLocalIterator()], window, k > 0)
        if k + 1 < n:
            found = written(found, "found")
    return found


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "benchmark_found.*")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


SQL = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, w FROM (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) t
  WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(10, len(w)) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item) t),
size AS (SELECT DISTINCT len(win) AS m FROM win),
doc AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w
  FROM documents),
spot AS (
  SELECT doc_id, i, m, list_slice(w, i, i + m - 1) AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, size) t),
found AS (SELECT doc_id, i, m, item_id FROM spot JOIN win USING (win)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT doc_id, i, m FROM found) s) t GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) t GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
