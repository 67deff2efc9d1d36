"""Repeated passages by a sparse suffix array over words.

Suffixes are kept only at content-selected positions: each window of ``LENGTH`` words selects the least of its first
``SPREAD`` runs of ``GRAM`` words (the leftmost of equals) and thereby a position. Equal windows select the same place in
themselves, so two equal passages of LENGTH words share a selected suffix, which has at least LENGTH - SPREAD + 1 words
of the passage to its right: its head.

1. The kept suffixes, about one for every 16 words, are sorted by hashes of their heads and compared with their
   neighbours. Those without an equal neighbour go; this only rules out.
2. The others are read with their words: the context of a suffix goes from the first to the last word of the windows
   that selected it. Equal contexts, by 128-bit digests of their words, become one with a count and the first place.
3. Contexts are sorted by the words from the suffix on, and neighbours are compared word by word. The longest common
   prefix with a neighbour says how far a match may extend to the right, and so how far it must extend to the left.
4. The windows that are left are sorted by digests of all their words and their places, and compared with neighbours:
   equal ones are a match, and all but the first are later ones. Matches that overlap or touch join to passages.

Every sort deals rows out by ranges of (value, place), so suffixes, contexts or windows that many places share are spread
over tasks. Tasks see rows one after another; the rows at the ends of a task, whose neighbours are elsewhere, pass in
steps 1 and 3, which only rule out, and are matched by themselves in step 4. No step depends on a group's size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilelake.llm.shared import written
from tilelake.llm.words import Words, _power, mix, ragged, words

LENGTH, GRAM, SPREAD = 50, 10, 31
HEAD = LENGTH - SPREAD + 1
#: Rows of windows that a task hands on at once.
ROWS = 20_000

_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def selected(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows of LENGTH words, the word that each selects, and prefix sums for hashes of word runs."""
    h = w.hashes()
    up, _ = _power(len(h) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:-1], dtype=np.uint64)])
    left = np.repeat(w.first[1:], np.diff(w.first)) - np.arange(len(h))
    start = np.flatnonzero(left >= LENGTH)
    if not len(start):
        return start, start, total
    value = np.full(len(h) + SPREAD, _MAX)
    real = np.flatnonzero(left >= GRAM)
    value[real] = run_hash(total, real, GRAM)
    place = np.arange(len(value))

    def lesser(step: int) -> None:
        nonlocal value, place
        better = value[step:] < value[:-step]
        value = np.where(better, value[step:], value[:-step])
        place = np.where(better, place[step:], place[:-step])

    for step in (1, 2, 4, 8, SPREAD - 16):  # runs of 2, 4, 8, 16 and SPREAD places
        lesser(step)
    return start, place[start], total


def run_hash(total: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each start."""
    return mix((total[start + n] - total[start]) * _power(len(total))[1][start])


def heads(total: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Hashes of the heads of suffixes. Equal heads have equal hashes; nothing else is asked of them."""
    return run_hash(total, p, HEAD).view(np.int64)


def _sparse(it):
    for b in it:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for w in words(b.column(1)):
            _, place, total = selected(w)
            p = np.unique(place)
            doc = np.searchsorted(w.first, p, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(heads(total, p)), pa.array(ids[w.rows.start + doc]), pa.array((p - w.first[doc]).astype(np.int32))], names=["head", "id", "p"])


def _shared(it):
    """(id, p) of the sorted rows (head, id, p) with a neighbour of equal head, and of a task's first and last."""
    held = None
    for b in it:
        head, i, p = (b.column(k).to_numpy() for k in range(3))
        if not len(head):
            continue
        if held is not None:
            head, i, p = (np.concatenate([x, y]) for x, y in zip(held[:3], (head, i, p), strict=True))
        like = head[1:] == head[:-1]
        keep = np.append(like, False)
        keep[1:] |= like
        keep[0] |= held is None or held[3]
        held = (head[-1:], i[-1:], p[-1:], bool(keep[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(i[:-1][keep[:-1]]), pa.array(p[:-1][keep[:-1]])], names=["id", "p"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(held[1]), pa.array(held[2])], names=["id", "p"])


CONTEXT = "id long, n_words long, s int, n int, off int, cut int, c binary, context binary"


def _extend(it):
    """The contexts of the suffixes p: from word s on, n windows, the suffix at word ``off`` and byte ``cut`` of it."""
    for b in it:
        ids, wanted = b.column(0).to_numpy(zero_copy_only=False), b.column(2)
        for w in words(b.column(1)):
            start, place, _ = selected(w)
            ask = wanted.slice(w.rows.start, len(w.rows))
            n_ask = np.diff(np.asarray(ask.offsets))
            p, stop = np.asarray(ask.flatten()) + np.repeat(w.first[:-1], n_ask), np.repeat(w.first[1:], n_ask)
            p = np.unique(p[p < stop])
            # windows that select p have consecutive starts
            lo, hi = np.searchsorted(place, p), np.searchsorted(place, p, "right")
            some = hi > lo
            p, lo, hi = p[some], lo[some], hi[some]
            first, last = (start[lo], start[hi - 1] + LENGTH - 1) if len(p) else (p, p)
            # the words with one space behind each
            length = w.end - w.start
            at = np.concatenate([[0], np.cumsum(length + 1)])
            joined = np.full(at[-1], 32, np.uint8)
            joined[ragged(at[:-1], length)] = w.data[ragged(w.start, length)]
            text, off = joined.tobytes(), (p - first).astype(np.int32)
            context = [text[i:j] for i, j in zip(at[first].tolist(), (at[last + 1] - 1).tolist(), strict=True)] if len(p) else []
            digest = [hashlib.blake2b(x, digest_size=16, person=o.to_bytes(4, "little")).digest() for x, o in zip(context, off.tolist(), strict=True)]
            doc = np.searchsorted(w.first, p, "right") - 1
            cols = [ids[w.rows.start + doc], np.diff(w.first)[doc].astype(np.int64), (first - w.first[doc]).astype(np.int32), (hi - lo).astype(np.int32), off, (at[p] - at[first]).astype(np.int32) if len(p) else off]
            yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in cols], pa.array(digest, pa.binary()), pa.array(context, pa.binary())], names=[x.split()[0] for x in CONTEXT.split(", ")])


def common_words(a: bytes, b: bytes) -> int:
    """The number of words at the start of both, words being joined by single spaces."""
    if a == b:
        return a.count(b" ") + 1
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    whole = (lo == len(a) or a[lo] == 32) and (lo == len(b) or b[lo] == 32)
    return a.count(b" ", 0, lo) + (1 if whole and lo else 0)


WINDOW = "w binary, c binary, k int, id long, s int"


def _windows(it):
    """The windows of contexts that are sorted by their words from the suffix on, as far as a neighbour allows: a window
    that begins d words before the suffix has LENGTH - d words in common with a neighbour, if it is repeated at all. A
    task's first and last context have all their windows."""
    out: list[list] = [[], [], [], [], []]

    def emit(row, reach: int | None) -> None:
        c, context, n, off, _, i, s = row
        top = n if reach is None else min(n, off - LENGTH + reach + 1)
        if top < 1:
            return
        edge = [-1]
        for _ in range(top + LENGTH - 1):
            at = context.find(b" ", edge[-1] + 1)
            edge.append(at if at >= 0 else len(context))
        out[0] += [hashlib.blake2b(context[edge[k] + 1 : edge[k + LENGTH]], digest_size=16).digest() for k in range(top)]
        for into, x in zip(out[1:], ([c] * top, range(top), [i] * top, range(s, s + top)), strict=True):
            into += x

    def flush():
        made = [pa.array(x, t) for x, t in zip(out, (pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int32()), strict=True)]
        for x in out:
            x.clear()
        return pa.RecordBatch.from_arrays(made, names=[x.split()[0] for x in WINDOW.split(", ")])

    held, before = None, None  # the last context, and the words that it has in common with the one before
    for b in it:
        for row in zip(*[x.to_pylist() for x in b.columns], strict=True):
            if held is not None:
                both = common_words(held[1][held[4] :], row[1][row[4] :])
                emit(held, None if before is None else max(before, both))
                before = both
            held = row
            if len(out[0]) >= ROWS:
                yield flush()
    if held is not None:
        emit(held, None)
    yield flush()


MATCH = "w binary, c binary, k int, id long, s int, twice boolean, later boolean, edge boolean"


def _match(it):
    """The rows of windows sorted by (w, id, s) that have an equal neighbour; later: the one before is equal. The first and
    the last row of a task are marked as edges and keep w."""
    begun, held = False, None

    def rows(t: pa.Table, pred, succ, edge):
        keep = np.flatnonzero(pred | succ | edge)
        w = pa.array([x if e else None for x, e in zip(t.column(0).take(pa.array(keep)).to_pylist(), edge[keep], strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([w, *[t.column(k).take(pa.array(keep)).combine_chunks() for k in range(1, 5)], *[pa.array(x[keep]) for x in (pred | succ, pred, edge)]], names=[x.split()[0] for x in MATCH.split(", ")])

    for b in it:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held[0], t]).combine_chunks()
        raw = np.frombuffer(b"".join(t.column(0).to_pylist()), np.uint64).reshape(-1, 2)
        like = (raw[1:] == raw[:-1]).all(axis=1)
        pred = np.concatenate([[held[1] if held is not None else False], like])
        edge = np.zeros(len(raw), bool)
        edge[0] = held is None and not begun
        if held is not None:
            edge[0] = held[2]
        begun, held = True, (t.slice(len(raw) - 1), bool(pred[-1]), bool(edge[-1]))
        if len(raw) > 1:
            yield rows(t.slice(0, len(raw) - 1), pred[:-1], like, edge[:-1])
    if held is not None:
        yield rows(held[0], np.array([held[1]]), np.zeros(1, bool), np.ones(1, bool))


def _merge(it):
    """Overlapping or touching spans of each row joined, for both columns of spans."""

    def joined(lists: pa.Array) -> pa.Array:
        row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
        flat = lists.flatten()
        start, end = (np.asarray(flat.field(k)).astype(np.int64) for k in range(2))
        order = np.lexsort((start, row))
        row, start, end = row[order], start[order], end[order]
        far = np.maximum.accumulate(row * (1 << 32) + end) if len(row) else end  # the farthest end of the row so far
        new = np.ones(len(row), bool)
        new[1:] = row[1:] * (1 << 32) + start[1:] > far[:-1]
        at = np.flatnonzero(new)
        stop = (far[np.append(at[1:], len(row)) - 1] & 0xFFFFFFFF) if len(at) else at
        spans = pa.StructArray.from_arrays([pa.array(start[at].astype(np.int32)), pa.array(stop.astype(np.int32))], names=["start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[at], np.arange(len(lists) + 1)).astype(np.int32)), spans)

    for b in it:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), joined(b.column(2)), joined(b.column(3))], names=["doc_id", "n_words", "passages", "later"])


def repeated_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_repeated, n_later, passages, later) of each document with repeated passages.

    A passage is repeated if each of its runs of 50 words occurs at another place too, in any document. passages are
    maximal spans of word numbers, ends exclusive, n_repeated the words in them; later and n_later are those of the runs
    that have an equal run at an earlier place, in order of (doc_id, place), which can go while every text stays once.
    Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Null and empty texts and texts of under 50 words have
    no passages. Rows without a doc_id are left out; rows that share one are parts of one document: their spans are
    joined, and equal runs at equal places of theirs are repeated, but none is later than the other. An empty table gives
    an empty result.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    sparse = written(own.mapInArrow(_sparse, "head long, id long, p int"), "suffixes")
    shared = sparse.repartitionByRange("head", "id", "p").sortWithinPartitions("head", "id", "p").mapInArrow(_shared, "id long, p int")
    asked = own.join(shared.groupBy("id").agg(F.collect_list("p").alias("p")), "id").select("id", "text", "p")
    found = written(asked.mapInArrow(_extend, CONTEXT), "contexts", compression="zstd")
    one = [F.any_value(x).alias(x) for x in ("context", "n", "off", "cut")]
    kinds = written(found.groupBy("c").agg(F.count("*").alias("times"), F.min(F.struct("id", "s")).alias("least"), *one).select("c", "context", "n", "off", "cut", "least.id", "least.s", "times"), "kinds", compression="zstd")
    right = F.expr("substring(context, cut + 1, length(context))")
    in_order = kinds.select("c", "context", "n", "off", "cut", "id", "s").repartitionByRange(right, "c").sortWithinPartitions(right, "c")
    window = written(in_order.mapInArrow(_windows, WINDOW), "windows")
    match = written(window.repartitionByRange("w", "id", "s").sortWithinPartitions("w", "id", "s").mapInArrow(_match, MATCH), "matches")
    # runs of equal windows that go over the ends of tasks
    edge = match.where("edge")
    by_w = edge.groupBy("w").agg(F.count("*").alias("rows"), F.min(F.struct("id", "s", "c")).alias("first"))
    met = edge.join(by_w, "w").select("c", "k", (F.col("twice") | (F.col("rows") > 1)).alias("twice"), (F.col("later") | (F.struct("id", "s", "c") > F.col("first"))).alias("later"))
    marks = match.where("not edge").select("c", "k", "twice", "later").union(met).where("twice").groupBy("c").agg(F.collect_list(F.struct("k", "later")).alias("marks"))
    known = kinds.select("c", "times", "id", "s").join(marks, "c", "left").where("times > 1 or marks is not null").select("c", "times", F.struct("id", "s").alias("least"), F.coalesce("marks", F.expr("cast(array() as array<struct<k:int,later:boolean>>)")).alias("marks"))
    span = lambda m: F.struct((F.col("s") + m["k"]).alias("start"), (F.col("s") + m["k"] + LENGTH).alias("end"))
    whole = F.array(F.struct(F.col("s").alias("start"), (F.col("s") + F.col("n") - 1 + LENGTH).alias("end")))
    spans = found.select("id", "n_words", "s", "n", "c").join(known, "c").select(
        "id", "n_words",
        F.when(F.col("times") > 1, whole).otherwise(F.transform("marks", span)).alias("all"),
        F.when(F.struct("id", "s") != F.col("least"), whole).otherwise(F.transform(F.filter("marks", lambda m: m["later"]), span)).alias("rest"),
    )
    by = spans.groupBy("id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("all")).alias("all"), F.flatten(F.collect_list("rest")).alias("rest"))
    got = by.mapInArrow(_merge, "doc_id long, n_words long, passages array<struct<start:int,end:int>>, later array<struct<start:int,end:int>>")
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return got.select("doc_id", "n_words", size("passages").alias("n_repeated"), size("later").alias("n_later"), "passages", "later")


def op8_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))))
    return found.select("doc_id", "n_words", "n_repeated", "n_later", text("passages").alias("passages"))


SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
win AS (SELECT doc_id, n_words, i, md5(array_to_string(list_slice(w, i + 1, i + 50), ' ')) AS h FROM (SELECT doc_id, w, len(w) AS n_words, unnest(range(0, len(w) - 49)) AS i FROM doc) t),
hit AS (SELECT doc_id, n_words, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS later FROM (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM win) t WHERE c > 1),
later AS (SELECT doc_id, count(DISTINCT k) AS n_later FROM (SELECT doc_id, unnest(range(i, i + 50)) AS k FROM hit WHERE later) t GROUP BY doc_id),
spot AS (SELECT doc_id, n_words, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM hit),
grp AS (SELECT doc_id, n_words, i, sum(CASE WHEN prev IS NULL OR i > prev + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM spot),
span AS (SELECT doc_id, n_words, min(i) AS a, max(i) + 50 AS b FROM grp GROUP BY doc_id, n_words, g)
SELECT doc_id, n_words, CAST(sum(b - a) AS BIGINT) AS n_repeated, CAST(coalesce(any_value(n_later), 0) AS BIGINT) AS n_later, string_agg(a || '-' || b, ',' ORDER BY a) AS passages
FROM span LEFT JOIN later USING (doc_id) GROUP BY doc_id, n_words
"""
