"""Periodic runs of words by grammar compression.

Re-Pair makes a grammar of each document: the most frequent pair of neighbouring symbols becomes a new symbol everywhere,
until no pair is there twice. A pair that is more frequent than every pair that shares a symbol with one of its occurrences
is replaced whole whatever else is replaced before, so all such pairs are replaced in one round, for all documents of a
slice at once; ties have a fixed order. A pair that is there once stays so and is cut off, so a round costs what is left.
The symbols that remain are joined by a balanced tree of further nonterminals, each used once.

A run lies within one lowest nonterminal and crosses the boundary of its two parts. So runs are looked for at the boundary
of each nonterminal once, in its first expansion, and translated to all places where it was made. Places where the text
goes on give parts of runs only; the whole ones come from nonterminals above, and intervals inside others of their period
go. An interval found for a multiple of its smallest period goes too.

What is pruned: a run of at least six words and four periods has each of its pairs of words at least three times, so it
can't reach over a pair that the document has less often; the search at a boundary stays between such pairs. Words are the
same if their 64-bit hashes are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilelake.llm.words import Words, attach, mix, ragged, runs, slices

#: A word is a run of other bytes than these.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Least words and periods of a run. The pruning needs three of each pair in a run, which these give.
WORDS, PERIODS = 6, 4

RUN = T.StructType([T.StructField(k, T.LongType(), False) for k in ("start", "length", "period")])
RUNS = T.StructType([T.StructField("n_words", T.LongType(), False), T.StructField("runs", T.ArrayType(RUN, False), False), T.StructField("collapsed", T.StringType(), False)])


@dataclass
class Grammar:
    """Rules of all documents of a slice, places counted in its words."""

    start: np.ndarray  # first place of each rule
    cut: np.ndarray  # start of its second part there
    end: np.ndarray
    rule: np.ndarray  # of each occurrence
    at: np.ndarray  # its place
    top: np.ndarray  # places of the symbols that remain
    thrice: np.ndarray  # whether the pair of a word and the next is in its document three times or more


def groups(key: np.ndarray) -> tuple[np.ndarray, int]:
    """The number of each key among the distinct ones, and how many there are."""
    order = np.argsort(key)
    sorted_, of = key[order], np.empty(len(key), np.int64)
    of[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])]) if len(key) else 0
    return of, int(of.max()) + 1 if len(key) else 0


def repair(h: np.ndarray, first: np.ndarray) -> Grammar:
    """Re-Pair of word hashes; ``first`` has the first word of each document and the number of all."""
    n = len(h)
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    own = mix(h + doc * np.uint64(0x9E3779B97F4A7C15))
    head, thrice, link = np.ones(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    inner = np.flatnonzero(doc[1:] == doc[:-1]) if n else np.zeros(0, np.int64)
    of, k = groups(mix(own[inner] + h[inner + 1]))
    count = np.bincount(of, minlength=k)[of]
    thrice[inner], link[inner] = count >= 3, count >= 2

    place = np.flatnonzero(link | np.concatenate([[False], link[:-1]]))
    symbol, link, size = groups(own[place])[0], link[place], np.ones(len(place), np.int64)
    symbols, rules = int(symbol.max(initial=-1)) + 1, 0
    made: list[tuple[np.ndarray, ...]] = []
    while link.any():
        i = np.flatnonzero(link)
        key = symbol[i] << 32 | symbol[i + 1]
        twin, idx = symbol[i] == symbol[i + 1], np.arange(len(i))
        goes_on = np.zeros(len(i), bool)
        goes_on[1:] = twin[1:] & (i[1:] == i[:-1] + 1) & (key[1:] == key[:-1])
        over = twin & ((idx - np.maximum.accumulate(np.where(goes_on, 0, idx))) % 2 == 1)  # in aaa the second aa
        of, k = groups(key)
        count = np.bincount(of[~over], minlength=k)
        link[i[count[of] < 2]] = False
        stays = count[of] >= 2
        i, of, over = i[stays], of[stays], over[stays]
        if len(i):
            rank = (count << 32 | (np.arange(k) * 0x9E3779B1) & 0xFFFFFFFF)[of]
            beside = i[1:] == i[:-1] + 1
            beaten = np.zeros(len(i), bool)
            beaten[1:] |= beside & (rank[:-1] > rank[1:])
            beaten[:-1] |= beside & (rank[1:] > rank[:-1])
            waits = np.zeros(k, bool)
            waits[of[beaten]] = True
            chosen = ~waits[of] & ~over
            i, of = i[chosen], of[chosen]
            _, at, number = np.unique(of, return_index=True, return_inverse=True)
            a, b = place[i], place[i + 1]
            made.append((a[at], b[at], b[at] + size[i + 1][at], rules + number, a))
            symbol[i] = symbols + number
            size[i] += size[i + 1]
            link[i] = link[i + 1]
            head[b] = False
            symbols, rules = symbols + len(at), rules + len(at)
        left = link.copy()
        left[1:] |= link[:-1]
        left[i + 1] = False
        if len(i):  # what follows a pair has its left neighbour in the pair
            after = i + 2
            after = after[after < len(left)]
            left[after] |= link[after - 2]
        symbol, link, size, place = symbol[left], link[left], size[left], place[left]
    start, cut, end, rule, at = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*made, strict=True)) if made else [np.zeros(0, np.int64)] * 5
    order = np.argsort(rule, kind="stable")
    return Grammar(start, cut, end, rule[order], at[order], np.flatnonzero(head), thrice)


def ahead(w: np.ndarray, x: int, y: int, stop: int) -> int:
    """How many words from x on equal those from y on, below stop."""
    n, step = 0, 32
    while y + n < stop:
        m = min(step, stop - y - n)
        differ = w[x + n : x + n + m] != w[y + n : y + n + m]
        if differ[k := int(differ.argmax())]:
            return n + k
        n, step = n + m, 2 * step
    return n


def across(w: np.ndarray, low: int, cut: int, high: int, found: list[tuple[int, int, int]]) -> None:
    """Adds the runs (start, end, period) within low .. high that have both the word before the cut and the one after it.

    A run has the pair at the cut again one period before or after."""
    most, a, b = (high - low) // PERIODS, w[cut - 1], w[cut]
    after, before = w[cut : min(high, cut + most + 1)], w[max(low, cut - most - 1) : cut]
    right = np.flatnonzero((after[1:] == b) & (after[:-1] == a)) + 1
    left = len(before) - 1 - np.flatnonzero((before[1:] == b) & (before[:-1] == a))
    period, anchor = np.concatenate([right, left]), np.concatenate([np.full(len(right), cut), cut - left])
    order = np.argsort(period, kind="stable")
    period, anchor = period[order], anchor[order]
    back = w[::-1]
    while len(period):
        q, i = int(period[0]), int(anchor[0])
        period, anchor = period[1:], anchor[1:]
        end = i + ahead(w, i, i + q, high) + q
        start = i - ahead(back, len(w) - i - q, len(w) - i, len(w) - low)
        if end - start >= max(WORDS, PERIODS * q):
            found.append((start, end, q))
            twice = (period % q == 0) & (anchor - 1 >= start) & (anchor + period < end)  # the same run by a multiple
            period, anchor = period[~twice], anchor[~twice]


def crossing(w: np.ndarray, thrice: np.ndarray, start: np.ndarray, cut: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The runs at the boundaries ``cut`` of expansions start .. end, with the number of the boundary."""
    stops = np.flatnonzero(~thrice)
    at = np.searchsorted(stops, cut - 1)
    low = np.maximum(start, np.where(at > 0, stops[at - 1] + 1, 0)) if len(stops) else start
    high = np.minimum(end, stops[at] + 1) if len(stops) else end
    which, found = [], []
    for k in np.flatnonzero(thrice[cut - 1] & (high - low >= WORDS)).tolist():
        across(w, int(low[k]), int(cut[k]), int(high[k]), found)
        which += [k] * (len(found) - len(which))
    return np.array(which, np.int64), found


def all_runs(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(start, end, period) of each run of all documents, by start and period."""
    g = repair(h, first)
    k, found = crossing(h, g.thrice, g.start, g.cut, g.end)
    out = np.array(found, np.int64).reshape(-1, 3)
    a, b = np.searchsorted(g.rule, k), np.searchsorted(g.rule, k, "right")
    move = g.at[ragged(a, b - a)] - np.repeat(g.start[k], b - a)
    out = np.repeat(out, b - a, axis=0) + np.stack([move, move, np.zeros_like(move)], axis=1)

    here = np.searchsorted(g.top, first)  # the first symbol of each document
    doc = np.repeat(np.arange(len(first) - 1), np.diff(here))
    j = np.arange(len(g.top)) - here[:-1][doc]
    keep = np.flatnonzero(j > 0)
    keep = keep[g.thrice[g.top[keep] - 1]]
    low = j[keep] & -j[keep]  # the node at the j-th boundary has so many symbols on either side
    edge = np.append(g.top, first[-1])
    _, found = crossing(h, g.thrice, edge[keep - low], g.top[keep], edge[np.minimum(keep + low, here[1:][doc[keep]])])
    out = np.concatenate([out, np.array(found, np.int64).reshape(-1, 3)])
    if not len(out):
        return out
    out = out[np.lexsort([-out[:, 1], out[:, 0], out[:, 2]])]
    reach = out[:, 1] + out[:, 2] * (len(h) + 1)  # periods one after another, so that one maximum runs over all
    whole = np.ones(len(out), bool)
    whole[1:] = (reach[1:] > np.maximum.accumulate(reach)[:-1]) | (out[1:, 2] != out[:-1, 2])
    out = out[whole]
    out = out[np.lexsort([out[:, 2], out[:, 1], out[:, 0]])]
    least = np.ones(len(out), bool)
    least[1:] = (out[1:, :2] != out[:-1, :2]).any(axis=1)
    out = out[least]
    return out[np.lexsort([out[:, 2], out[:, 0]])]


def _slice(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    start, end = runs(~SPACE[data], offsets)
    first = np.searchsorted(start, offsets)
    docs = len(first) - 1
    found = all_runs(Words(data, start, end, first, range(docs)).hashes(), first)
    drop = np.zeros(len(start) + 1, np.int64)
    np.add.at(drop, found[:, 0] + found[:, 2], 1)
    np.add.at(drop, found[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(drop)[:-1] == 0)
    doc = np.searchsorted(first, kept, "right") - 1
    last = np.append(doc[1:] != doc[:-1], True)[: len(doc)]
    length = end[kept] - start[kept] + ~last  # with a space behind, but for a document's last word
    text = np.append(data, np.uint8(32))[ragged(start[kept], length)]
    ends = np.cumsum(length)
    text[ends[~last] - 1] = 32
    at = np.append(0, ends)[np.searchsorted(doc, np.arange(docs + 1))]
    collapsed = pa.Array.from_buffers(pa.large_string(), docs, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(text)]).cast(pa.string())
    of = np.searchsorted(found[:, 0], first)
    each = pa.StructArray.from_arrays([pa.array(found[:, 0] - first[np.searchsorted(first, found[:, 0], "right") - 1]), pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2])], fields=[pa.field(k, pa.int64(), False) for k in RUN.names])
    kind = pa.list_(pa.field("element", each.type, False))
    return pa.StructArray.from_arrays([pa.array(np.diff(first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(of, pa.int32()), each).cast(kind), collapsed], fields=[pa.field("n_words", pa.int64(), False), pa.field("runs", kind, False), pa.field("collapsed", pa.string(), False)])


def periodic_runs(docs: DataFrame, *, text: str = "text", out: str = "periodic") -> DataFrame:
    """docs with a struct ``out``: n_words, the runs (start, length, period; by start, then period) and the collapsed text.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of at least six words and four of its smallest
    period that can't be longer on either side. The collapsed text has one space between words and lacks those that some
    run has after its first period.

    Null, empty and blank texts have no words, no runs and an empty collapsed text. Rows are looked at one by one, repeated
    ones too; nothing is shuffled, and a task holds slices of a batch of about a megabyte, or one longer text. A column of
    docs named ``out`` is replaced, other names don't matter. An empty table gives an empty one.
    """

    def one(b: pa.RecordBatch) -> pa.Array:
        texts = b.column(b.schema.names.index(text))
        made = [_slice(data, offsets) for data, offsets, _ in slices(texts)]
        return pa.concat_arrays(made) if made else pa.array([], pa.struct([]))

    return attach(docs, out, RUNS, one)


def with_repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs whose texts end in repeated words, where crc32 of the decimal doc_id is divisible by ten: each word i from a on is
    word a + (i - a) % p; a and p follow from the crc32. Others stay as they are."""
    code = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(code / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    n = F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a), repeated), " ")
    return docs.withColumn(text, F.when((code % 10 == 0) & (n > 0), made).otherwise(F.col(text)))


def strongest(found: Column) -> Column:
    """The run of greatest length / period, the earliest of equal ones; null if there is none."""
    return F.aggregate(F.slice(found, 2, F.greatest(F.size(found), F.lit(1))), F.get(found, 0), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    lines = F.array_join(F.transform("periodic.runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return periodic_runs(docs).withColumn("best", strongest(F.col("periodic.runs"))).select(
        "doc_id",
        F.size("periodic.runs").cast("long").alias("n_runs"),
        "best.*",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("periodic.collapsed", 256).alias("collapsed_sha256"),
    )


#: The table of crc32 and crc32 itself of a list of bytes, for SQL.
CRC_TABLE = """SELECT list(c ORDER BY k) AS t FROM
  (SELECT k, list_reduce([k] || range(8), lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(k))"""


def crc_sql(given: str) -> str:
    return f"xor(list_reduce([4294967295::BIGINT] || {given}, lambda c, byte: xor(c >> 8, t[(xor(c, byte) & 255) + 1])), 4294967295)"


SQL = rf"""
WITH crc AS ({CRC_TABLE}),
coded AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
  {crc_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)")} AS h FROM documents, crc),
repeating AS (SELECT *, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) ELSE len(words) END AS a FROM coded),
word AS (SELECT doc_id, n, i, words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END] AS word
  FROM repeating, unnest(range(n)) AS u(i)),
equal AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM word AS x JOIN word AS y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretch AS (SELECT doc_id, q, min(i) AS s, max(i) + 1 + q AS e
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM equal) GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT doc_id, s, e, min(q) AS q FROM stretch GROUP BY doc_id, s, e),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(s, ',', e - s, ',', q, chr(10)), '' ORDER BY s, q) AS lines,
  arg_max({{'start': s, 'length': e - s, 'period': q}}, ((e - s)::DOUBLE / q, -s, -q)) AS best FROM run GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM word
  WHERE NOT EXISTS (SELECT 1 FROM run WHERE run.doc_id = word.doc_id AND i >= s + q AND i < e) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, best.length * 1000 // best.period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
