"""Quality rules by distribution divergence.

Each language's reference has two histograms over all its documents: of character classes, and of its common words,
which are the words that make up at least ``COMMON`` of the language's words, with one more bin for all other words. A
document is compared with its language's reference by Jensen-Shannon distance. A language with fewer than ``LEAST_WORDS``
words in all has no reference. References are made from the corpus that is judged, junk included, unless others are given.

The words are counted in two narrow passes. The first keeps a summary of heavy hitters (Misra-Gries) of at most
``COUNTERS`` words for each language in a task. A summary's count of a word falls short by at most the words it has seen
over COUNTERS + 1, and so does the sum of all tasks' counts; words whose sum is too small for COMMON all the same are left
out, which leaves at most 1 / (COMMON - 1 / COUNTERS) candidates of a language, 222. The second pass counts these exactly.

References are a table with a row for each language. Tasks get them by broadcast for ``LANGUAGES`` languages at once, some
6 KB each; if there are more, the documents are read in as many parts by language.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilelake.llm.shared import saved
from tilelake.llm.words import Words, _LOWER, attach, mix, ragged, runs, slices

COMMON = 0.005
COUNTERS = 2000
LEAST_WORDS = 1000
#: Languages whose references or candidates are sent to the tasks at once.
LANGUAGES = 5000

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True

#: Class of each leading byte; 255 for the bytes that continue a character.
N_CLASSES = 9
CLASS = np.full(256, 6, np.uint8)  # other ASCII
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 0, 1, 2
CLASS[SPACE] = 3
CLASS[list(b".,;:!?'\"()-")] = 4
CLASS[SYMBOL] = 5
CLASS[0x80:0xC0] = 255
CLASS[0xC0:0xE0] = 7
CLASS[0xE0:] = 8

JUDGED = T.StructType([T.StructField(k, T.LongType(), False) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
SCORED = T.StructType([*JUDGED.fields, *[T.StructField(k, T.DoubleType()) for k in ("class_distance", "word_distance")], T.StructField("base_failed", T.BooleanType(), False), T.StructField("kept", T.BooleanType(), False)])


def split(text: pa.Array):
    """Slices as Words of ``[^\\x20\\x09-\\x0D]+``, bytes as they are, with the slice's document offsets."""
    for data, offsets, rows in slices(text):
        start, end = runs(~SPACE[data], offsets)
        yield Words(data, start, end, np.searchsorted(start, offsets), rows), offsets


def _per_doc(inside: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(inside)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(Words(data, start, end, np.zeros(0), range(0)).hashes() + (end - start).astype(np.uint64))


def _repeats(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the entries by (doc, hash), and for each in that order whether the one before is equal."""
    order = np.lexsort((h, doc))
    same = np.zeros(len(h), bool)
    same[1:] = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    return order, same


def base(w: Words, offsets: np.ndarray, h: np.ndarray) -> dict[str, np.ndarray]:
    """The plain counts of each document of a slice."""
    n_docs, data = len(offsets) - 1, w.data
    inside = ~SPACE[data]
    out = {"n_words": np.diff(w.first), "word_chars": _per_doc(inside & ((data & 0xC0) != 0x80), offsets), "n_symbols": _per_doc(SYMBOL[data], offsets)}
    line_start, line_end = runs(data != 10, offsets)
    has = np.searchsorted(w.start, line_end) > np.searchsorted(w.start, line_start)
    line_start, line_end = line_start[has], line_end[has]
    doc = np.searchsorted(offsets, line_start, "right") - 1
    order, same = _repeats(doc, _span_hashes(data, line_start, line_end))
    out["n_dup_lines"] = np.bincount(doc[order][same], minlength=n_docs)
    cover = np.zeros(w.n + 1, np.int64)
    left = np.repeat(w.first[1:], np.diff(w.first)) - np.arange(w.n)
    at = np.flatnonzero(left >= 5)
    if len(at):
        g = np.zeros(len(at), np.uint64)
        for k in range(5):
            g = mix(g + h[at + k])
        owner = w.doc()
        order, same = _repeats(owner[at], g)
        twice = same.copy()
        twice[:-1] |= same[1:]
        begin = at[order[twice]]
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + 5, -1)
        out["n_repeat_words"] = np.bincount(owner[np.cumsum(cover[:-1]) > 0], minlength=n_docs)
    else:
        out["n_repeat_words"] = np.zeros(n_docs, np.int64)
    return out


def classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents × classes: counts of characters."""
    c = CLASS[data]
    lead = c != 255
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return np.bincount(doc[lead] * N_CLASSES + c[lead], minlength=(len(offsets) - 1) * N_CLASSES).reshape(-1, N_CLASSES)


def _langs(column: pa.Array) -> np.ndarray:
    return np.array([x if x is not None else "" for x in column.to_pylist()], dtype=object)


def _folded(w: Words) -> np.ndarray:
    """Hashes of the words with A-Z lower-cased."""
    return Words(_LOWER[w.data], w.start, w.end, w.first, w.rows).hashes()


STATS = "lang string, kind string, word string, bin int, n long"


class Heavy:
    """A mergeable summary of the words of a stream: at most COUNTERS hashes with counts that are too small by at most the
    words seen over COUNTERS + 1."""

    def __init__(self):
        self.key, self.n, self.names = np.zeros(0, np.uint64), np.zeros(0, np.int64), {}

    def add(self, w: Words, at: np.ndarray, h: np.ndarray) -> None:
        """The words ``at`` of w, with their hashes."""
        new, first, count = np.unique(h, return_index=True, return_counts=True)
        key, back = np.unique(np.concatenate([self.key, new]), return_inverse=True)
        n = np.bincount(back, np.concatenate([self.n, count]), len(key)).astype(np.int64)
        if len(key) > COUNTERS:
            n -= np.partition(n, len(n) - COUNTERS - 1)[len(n) - COUNTERS - 1]
            key, n = key[n > 0], n[n > 0]
        self.key, self.n = key, n
        spot = np.minimum(np.searchsorted(new, key), max(0, len(new) - 1))
        for k, f in zip(key.tolist(), at[first[spot]].tolist(), strict=True) if len(new) else ():
            if k not in self.names:
                self.names[k] = (w.start[f], w.end[f], w)
        self.names = {k: _LOWER[v[2].data[v[0] : v[1]]].tobytes().decode("utf-8", "replace") if isinstance(v := self.names[k], tuple) else v for k in key.tolist()}


def _survey(text: str, lang: str):
    """First pass: for each task and language, its words, its classes and the summary of its words."""

    def batches(it):
        totals: dict[str, int] = {}
        hists: dict[str, np.ndarray] = {}
        heavy: dict[str, Heavy] = {}
        for b in it:
            langs = _langs(b.column(b.schema.names.index(lang)))
            for w, offsets in split(b.column(b.schema.names.index(text))):
                own, hist, h = langs[w.rows.start : w.rows.stop], classes(w.data, offsets), _folded(w)
                owner = w.doc()
                for one in sorted(set(own)):
                    mine = own == one
                    hists[one] = hists.get(one, 0) + hist[mine].sum(axis=0)
                    at = np.flatnonzero(mine[owner])
                    totals[one] = totals.get(one, 0) + len(at)
                    heavy.setdefault(one, Heavy()).add(w, at, h[at])
        rows = []
        for one, n in totals.items():
            rows.append((one, "total", None, 0, n))
            rows += [(one, "class", None, k, int(x)) for k, x in enumerate(hists[one]) if x]
            rows += [(one, "word", heavy[one].names[k], 0, n) for k, n in zip(heavy[one].key.tolist(), heavy[one].n.tolist(), strict=True)]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["lang", "kind", "word", "bin", "n"])

    return batches


def word_keys(words: list[str]) -> np.ndarray:
    """The hash that _folded gives to each of these words."""
    data = "".join(words).encode()
    ends = np.cumsum([len(x.encode()) for x in words], dtype=np.int64)
    return Words(np.frombuffer(data, np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends, np.zeros(0), range(0)).hashes()


def _count(shared, text: str, lang: str):
    """Second pass: counts of the candidate words; shared: sorted (language, word) pairs."""

    def batches(it):
        by: dict[str, list[int]] = {}
        for k, (one, _) in enumerate(shared.value):
            by.setdefault(one, []).append(k)
        known = {}
        for one, ks in by.items():
            keys = word_keys([shared.value[k][1] for k in ks])
            order = np.argsort(keys)
            known[one] = keys[order], np.array(ks)[order]
        for b in it:
            total, langs = np.zeros(len(shared.value), np.int64), _langs(b.column(b.schema.names.index(lang)))
            for w, _ in split(b.column(b.schema.names.index(text))):
                own, h, owner = langs[w.rows.start : w.rows.stop], _folded(w), w.doc()
                for one in set(own) & set(known):
                    keys, ks = known[one]
                    x = h[(own == one)[owner]]
                    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                    total += np.bincount(ks[at[keys[at] == x]], minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([shared.value[k][0] for k in some], pa.string()), pa.array([shared.value[k][1] for k in some], pa.string()), pa.array(total[some])], names=["lang", "word", "n"])

    return batches


def _parts(table: DataFrame, docs: DataFrame, lang: str):
    """(rows of table, documents) by language, LANGUAGES or so at once; table has a column lang."""
    n = max(1, -(-table.select("lang").distinct().count() // LANGUAGES))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(n))
    for k in range(n):
        yield list(table.where(part(F.col("lang")) == k).toLocalIterator()), docs if n == 1 else docs.where(part(F.coalesce(F.col(lang).cast("string"), F.lit(""))) == k)


def candidates(seen: DataFrame) -> DataFrame:
    """(lang, total, word) of the words that may be common, from the sums of all tasks' summaries."""
    total = seen.where((F.col("kind") == "total") & (F.col("n") >= LEAST_WORDS)).select("lang", F.col("n").alias("total"))
    return seen.where("kind = 'word'").select("lang", "word", "n").join(total, "lang").where(F.col("n") >= COMMON * F.col("total") - F.col("total") / (COUNTERS + 1)).select("lang", "total", "word")


def references(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, total, classes, words, counts) of each language with at least LEAST_WORDS words: its words in all, the counts
    of its characters by class, its common words and their counts."""
    sc = docs.sparkSession.sparkContext
    own = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    seen = saved(own.mapInArrow(_survey("text", "lang"), STATS).groupBy("lang", "kind", "word", "bin").agg(F.sum("n").alias("n")))
    total = seen.where((F.col("kind") == "total") & (F.col("n") >= LEAST_WORDS)).select("lang", F.col("n").alias("total"))
    counted = []
    for rows, part in _parts(saved(candidates(seen)), own, "lang"):
        if rows:
            shared = sc.broadcast(sorted((r.lang, r.word) for r in rows))
            counted.append(part.mapInArrow(_count(shared, "text", "lang"), "lang string, word string, n long"))
    zero = docs.sparkSession.createDataFrame([], "lang string, word string, n long")
    each = reduce(DataFrame.union, counted, zero).groupBy("lang", "word").agg(F.sum("n").alias("n")).join(total, "lang").where(F.col("n") >= COMMON * F.col("total"))
    words = each.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("w"))
    chars = seen.where("kind = 'class'").groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    made = total.join(chars, "lang", "left").join(words, "lang", "left")
    count = F.transform(F.sequence(F.lit(0), F.lit(N_CLASSES - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit(0)))
    pick = lambda f, kind: F.coalesce(F.transform("w", lambda x: x[f]), F.array().cast(f"array<{kind}>"))
    return saved(made.select("lang", "total", count.alias("classes"), pick("word", "string").alias("words"), pick("n", "long").alias("counts")))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of counts p to the distribution q; a row of zeros is NaN."""
    total = p.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = p / total, np.broadcast_to(q, p.shape)
        m = (p + q) / 2
        half = [np.where(x > 0, x * np.log2(x / m), 0).sum(axis=1) for x in (p, q)]
        return np.where(total[:, 0] > 0, np.sqrt(np.maximum(0, (half[0] + half[1]) / 2)), np.nan)


def judge(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", out: str = "quality", min_words: int = 50, max_class: float = 0.32, max_word: float = 0.42, refs: DataFrame | None = None
) -> DataFrame:
    """docs with a struct ``out``: plain counts, the two distances, base_failed and kept.

    Words are ``[^\\x20\\x09-\\x0D]+``. word_chars: code points in words. n_symbols: characters ``[#*$%&|<>]``. n_dup_lines:
    lines with a word that equal an earlier line. n_repeat_words: words in 5-word windows found twice or more. A document
    fails the base rules if it has fewer than 10 words or 100 * n_repeat_words > 20 * n_words; it is kept if it doesn't
    and neither distance is over its limit. A distance is null, and so never over its limit, where the document has fewer
    than ``min_words`` words or its language no reference. Null text: no words. Null language: the language ''. Repeated
    rows are judged alike and count each time in the references; an empty table gives an empty result. A column of docs
    named ``out`` is replaced. ``refs``: references made before from other documents, else they are made from docs.
    """
    refs = references(docs, text=text, lang=lang) if refs is None else refs
    sc = docs.sparkSession.sparkContext
    parts = [attach(part, out, SCORED, _score(sc.broadcast({r.lang: r.asDict() for r in rows}), text, lang, min_words, max_class, max_word)) for rows, part in _parts(refs, docs, lang)]
    return reduce(DataFrame.union, parts)


def _score(shared, text: str, lang: str, min_words: int, max_class: float, max_word: float):
    """Arrow table of a batch → the struct of judge; shared: references by language."""
    ready: dict[str, tuple] = {}

    def score(b: pa.RecordBatch) -> pa.Array:
        for one, r in shared.value.items() if not ready else ():
            keys = word_keys(r["words"])
            order, n = np.argsort(keys), np.array(r["counts"], np.float64)
            ready[one] = np.array(r["classes"]) / max(1, sum(r["classes"])), keys[order], np.append(n[order], r["total"] - n.sum()) / r["total"]
        langs, parts = _langs(b.column(b.schema.names.index(lang)).cast(pa.string())), []
        for w, offsets in split(b.column(b.schema.names.index(text))):
            part = base(w, offsets, w.hashes())
            n = len(offsets) - 1
            part["class_distance"], part["word_distance"] = np.full(n, np.nan), np.full(n, np.nan)
            own, hist, h, owner = langs[w.rows.start : w.rows.stop], classes(w.data, offsets), _folded(w), w.doc()
            for one in set(own) & set(ready):
                q, keys, bins = ready[one]
                mine = np.flatnonzero((own == one) & (part["n_words"] >= min_words))
                if not len(mine):
                    continue
                part["class_distance"][mine] = distance(hist[mine], q)
                at = ragged(w.first[mine], part["n_words"][mine])
                k = np.full(len(at), len(keys))
                if len(keys):
                    near = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
                    k = np.where(keys[near] == h[at], near, len(keys))
                place = np.repeat(np.arange(len(mine)), part["n_words"][mine])
                p = np.bincount(place * len(bins) + k, minlength=len(mine) * len(bins)).reshape(-1, len(bins))
                part["word_distance"][mine] = distance(p, bins)
            parts.append(part)
        cols = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance")}
        failed = (cols["n_words"] < 10) | (100 * cols["n_repeat_words"] > 20 * cols["n_words"])
        with np.errstate(invalid="ignore"):
            kept = ~failed & ~(cols["class_distance"] > max_class) & ~(cols["word_distance"] > max_word)
        fields = [pa.array(x, pa.float64(), mask=np.isnan(x)) if "distance" in k else pa.array(x.astype(np.int64)) for k, x in cols.items()]
        return pa.StructArray.from_arrays([*fields, pa.array(failed), pa.array(kept)], names=[*cols, "base_failed", "kept"])

    return score


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judge(docs).select("doc_id", "quality.*").withColumns({k: F.round(k, 6) for k in ("class_distance", "word_distance")})


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w) t),
rep AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS k FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win) a WHERE c > 1) b
  GROUP BY doc_id),
base AS (
  SELECT w.doc_id, lang, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
            - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
one AS (
  SELECT doc_id, lang, word, count(*) AS n
  FROM (SELECT doc_id, lang, unnest(list_transform(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS word FROM w) x
  GROUP BY doc_id, lang, word),
total AS (SELECT lang, sum(n_words) AS total FROM base GROUP BY lang HAVING sum(n_words) >= 1000),
common AS (SELECT lang, word, n / total::DOUBLE AS q FROM (SELECT lang, word, sum(n) AS n FROM one GROUP BY lang, word) a JOIN total USING (lang) WHERE n >= 0.005e0 * total),
bin AS (
  SELECT doc_id, n_words, q, coalesce(n, 0) / n_words::DOUBLE AS p
  FROM (SELECT doc_id, lang, n_words, word, q FROM base JOIN common USING (lang) WHERE n_words >= 50) a LEFT JOIN one USING (doc_id, lang, word)),
rest AS (
  SELECT doc_id, 1 - coalesce(sum(q), 0) AS q, 1 - coalesce(sum(p), 0) AS p
  FROM (SELECT doc_id FROM base JOIN total USING (lang) WHERE n_words >= 50) a LEFT JOIN bin USING (doc_id) GROUP BY doc_id),
word AS (
  SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN p > 1e-15 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 1e-15 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS word_distance
  FROM (SELECT doc_id, p, q FROM bin UNION ALL SELECT doc_id, p, q FROM rest) x GROUP BY doc_id),
chars AS (
  SELECT doc_id, lang, n_words, k, CASE k
      WHEN 0 THEN length(regexp_replace(t, '[^a-z]', '', 'g')) WHEN 1 THEN length(regexp_replace(t, '[^A-Z]', '', 'g')) WHEN 2 THEN length(regexp_replace(t, '[^0-9]', '', 'g'))
      WHEN 3 THEN length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) WHEN 4 THEN length(regexp_replace(t, '[^.,;:!?''"()\-]', '', 'g'))
      WHEN 5 THEN n_symbols WHEN 6 THEN length(regexp_replace(t, '[a-zA-Z0-9\x20\x09-\x0D.,;:!?''"()\-#*$%&|<>]|[^\x00-\x7F]', '', 'g'))
      WHEN 7 THEN length(regexp_replace(t, '[\x00-\x7F]|[^\x00-\x{7FF}]', '', 'g')) ELSE length(regexp_replace(t, '[\x00-\x{7FF}]', '', 'g')) END AS n
  FROM base, (SELECT unnest(range(0, 9)) AS k) z),
cq AS (SELECT lang, k, sum(n) / sum(sum(n)) OVER (PARTITION BY lang)::DOUBLE AS q FROM chars JOIN total USING (lang) GROUP BY lang, k),
class AS (
  SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS class_distance
  FROM (SELECT doc_id, q, n / sum(n) OVER (PARTITION BY doc_id)::DOUBLE AS p FROM chars JOIN cq USING (lang, k) WHERE n_words >= 50) x GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance,
       base_failed, NOT base_failed AND coalesce(class_distance, 0) <= 0.32 AND coalesce(word_distance, 0) <= 0.42 AS kept
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base) b LEFT JOIN class USING (doc_id) LEFT JOIN word USING (doc_id)
"""
