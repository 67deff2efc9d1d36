"""Spelling variants: words of one edit's distance, found by walking a trie as a relation, and their most frequent forms.

States are (word, position, node, edits). The zero-edit states of a word are the nodes of its own path. Joined with the
table of edges, each of them goes on over the edges of other words with one code point inserted, deleted or replaced, and
becomes a one-edit state; these are joined with the edges level by level and must match from there on. Those that end where
a word ends are neighbours.

An edit lies in the second half of a word or in the first half, which is the second one of the word read backwards. So
there are two tries, of the words and of the reversed words; an edit is looked for below the half only, where nodes have
few children, and only these lower parts are built. An edit comes at the end of what two words have in common, so a pair
has one place of it in each trie, and pairs that both tries have are taken from the first.

The tries are path-compressed: a node is explicit where paths part, a word ends or a lower part begins, and an edge has all
code points up to the next one. A level is a branching, so two very long words need few of them. Nodes are 64-bit hashes
of their prefixes, made in one pass over a word; what a collision would let through is ruled out by the exact words.

A node may be on the path of a third of all words. Keys with more than a 1024th of the states are at most 1024, with at
most one edge for each letter, and are broadcast; see ``spread_join``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilelake.llm.linededup import LOWER, UPPER
from tilelake.llm.periodic import CRC_TABLE, crc_sql
from tilelake.llm.shared import spread_join, written
from tilelake.llm.words import mix, ragged

#: Letters of words, and those of A-Z lower-cased.
LETTERS = r"[a-zÀ-ÿ]"
_BASE = np.uint64(0x9E3779B97F4A7C15)

#: What follows a word; no letter. In a word it would only let more candidates through.
END = "\0"

PATHS = "backwards boolean, word string, pos int, node long, next int, stop boolean"


def word_runs(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_chars: int = 5) -> DataFrame:
    """(doc_id, word): each maximal run of letters of at least min_chars code points, A-Z lower-cased; null text has none."""
    found = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(f"({LETTERS}{{{min_chars},}})"), F.lit(1))
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(found).alias("word"))


def vocabulary(words: DataFrame, *, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n) of the words of at least min_chars code points that are there min_count times or more."""
    return words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _paths(words: list[str], backwards: bool) -> pa.RecordBatch:
    """The lower half of the path of each word: positions with the node there and the code point that follows, -1 at its end."""
    words = [w[::-1] for w in words] if backwards else words
    length = np.array([len(w) for w in words], np.int64)
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    first = np.cumsum(length) - length
    place = ragged(np.zeros(len(words), np.int64), length)
    power = np.full(int(length.max(initial=0)) + 1, _BASE, np.uint64)
    power[0] = 1
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(code + _BASE) * np.cumprod(power, dtype=np.uint64)[place], dtype=np.uint64)])
    half = (length - 1) // 2
    rows = length - half + 1
    of = np.repeat(np.arange(len(words)), rows)
    pos = ragged(half, rows)
    node = mix(total[first[of] + pos] - total[first[of]] + mix(pos.astype(np.uint64) * np.uint64(2) + np.uint64(backwards)))
    ends = pos == length[of]
    following = np.where(ends, -1, np.append(code, np.uint64(0)).astype(np.int64)[first[of] + pos])
    columns = [pa.array(np.full(len(of), backwards)), pa.array(words, pa.string()).take(pa.array(of)), pa.array(pos.astype(np.int32)), pa.array(node.view(np.int64)), pa.array(following.astype(np.int32)), pa.array(ends | (pos == half[of]))]
    return pa.RecordBatch.from_arrays(columns, names=["backwards", "word", "pos", "node", "next", "stop"])


def trie_paths(vocab: DataFrame, *, batch_chars: int = 1 << 20) -> DataFrame:
    """(backwards, word, pos, node, ends, to, child, child_ends): the explicit nodes below the half of each word in both
    tries, each with the next one on the word's path; ends: whether a word ends there."""

    def rows(batches):
        for b in batches:
            words = b.column(0).to_pylist()
            size = np.cumsum([0] + [len(w) for w in words])
            at = 0
            while at < len(words):
                to = max(at + 1, int(np.searchsorted(size, size[at] + batch_chars, "right")) - 1)
                for backwards in (False, True):
                    yield _paths(words[at:to], backwards)
                at = to

    paths = vocab.select("word").mapInArrow(rows, PATHS)
    nodes = paths.groupBy("node").agg(F.min("next").alias("least"), F.max("next").alias("most"), F.max("stop").alias("stop"))
    nodes = nodes.where(F.col("stop") | (F.col("least") != F.col("most"))).select("node", (F.col("least") == -1).alias("ends"))
    kept = spread_join(written(paths.drop("next", "stop"), "paths"), written(nodes, "nodes"), ["node"])
    on = Window.partitionBy("backwards", "word").orderBy("pos")
    return kept.select("*", F.lead("pos").over(on).alias("to"), F.lead("node").over(on).alias("child"), F.lead("ends").over(on).alias("child_ends"))


def trie_edges(paths: DataFrame) -> DataFrame:
    """(node, first, label, child, ends, follow): the edges, each once; follow has the code points that can follow the label,
    ``END`` if a word ends there."""
    label = F.substring(F.col("word"), F.col("pos") + 1, F.col("to") - F.col("pos"))
    edges = paths.where("child is not null").select("node", F.substring(label, 1, 1).alias("first"), label.alias("label"), "child", F.col("child_ends").alias("ends")).dropDuplicates(["node", "child", "first"])
    edges = written(edges, "edges")
    follow = edges.groupBy(F.col("node").alias("child")).agg(F.array_join(F.collect_set("first"), "").alias("follow"))
    return edges.join(follow, "child", "left").withColumn("follow", F.concat(F.coalesce("follow", F.lit("")), F.when(F.col("ends"), F.lit(END)).otherwise("")))


def _piece(s: Column, at: Column, n: Column | None = None) -> Column:
    """n code points from the place at on, or all."""
    return F.substring(s, at + 1, n if n is not None else F.greatest(F.length(s) - at, F.lit(0)))


def _next(word: Column, at: Column) -> Column:
    """The code point at a place, END behind the word."""
    return F.when(at < F.length(word), F.substring(word, at + 1, F.lit(1))).otherwise(F.lit(END))


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, near) of each two words that differ by one inserted, deleted or replaced code point, in both orders."""
    paths = written(trie_paths(vocab), "trie-paths")
    edges = written(trie_edges(paths), "trie-edges")
    w, i, length, label, size, can_follow = F.col("word"), F.col("pos"), F.length("word"), F.col("label"), F.length("label"), F.col("follow")
    half = F.floor(length / 2).cast("int")  # what an edit must leave in front; the other part when read backwards
    zero = paths.where(i >= F.when(F.col("backwards"), length - half).otherwise(half)).select("backwards", "word", "pos", "node", "ends", _next(w, i).alias("here"), F.when(i < length, _next(w, i + 1)).alias("beyond"))
    found = [zero.where(F.col("ends") & (i == length - 1)).select("backwards", "word", _piece(w, F.lit(0), i).alias("near"))]

    # What comes after the label's first code point says of most edges at once that no edit can be there.
    second = F.when(size > 1, F.substring(label, 2, 1)).otherwise(can_follow)
    met = spread_join(zero.drop("ends"), edges.withColumn("second", second), ["node"]).where(
        (F.col("first") != F.col("here")) & (F.contains("second", "here") | F.coalesce(F.contains("second", "beyond") | (F.col("first") == F.col("beyond")), F.lit(False)))
    )

    def state(ok: Column, at: Column, near: Column) -> Column:
        return F.when(ok & F.contains(can_follow, _next(w, at)), F.struct(at.alias("pos"), near.alias("near")))

    front = _piece(w, F.lit(0), i)
    inserted = state(_piece(w, i, size - 1) == _piece(label, F.lit(1)), i + size - 1, F.concat(front, "first", _piece(w, i)))
    replaced = state((i < length) & (_piece(w, i + 1, size - 1) == _piece(label, F.lit(1))), i + size, F.concat(front, "first", _piece(w, i + 1)))
    deleted = state((i < length) & (_piece(w, i + 1, size) == label), i + size + 1, F.concat(front, _piece(w, i + 1)))
    states = met.select("backwards", "word", F.col("child").alias("node"), F.explode(F.filter(F.array(inserted, replaced, deleted), lambda x: x.isNotNull())).alias("x")).select("backwards", "word", "node", "x.*")
    while True:
        states = written(states.select("*", _piece(w, i, F.lit(1)).alias("first")), "one-edit")
        found.append(states.where(i == length).select("backwards", "word", "near"))
        going = states.where(i < length)
        if going.isEmpty():
            break
        met = spread_join(going, edges.drop("ends"), ["node", "first"]).where((_piece(w, i, size) == label) & F.contains(can_follow, _next(w, i + size)))
        states = met.select("backwards", "word", F.col("child").alias("node"), (i + size).alias("pos"), "near")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    near = F.col("near")
    late = _piece(w, length - half) == _piece(near, F.length(near) - half)  # both tries have the pair
    turned = lambda c: F.when(F.col("backwards"), F.reverse(c)).otherwise(c)
    return pairs.where(~F.col("backwards") | ~late).select(turned(w).alias("word"), turned(near).alias("near"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): where following forms ends. The way still to go halves in each round."""
    ups = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = ups.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        met = spread_join(ups, on, ["root"], how="left")
        ups = written(met.select("word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "forms")
        if ups.where("moved").isEmpty():
            return ups.select("word", "root")
        ups = ups.drop("moved")


def spelling_variants(vocab: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of vocab (word, n).

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its near word
    of largest n, the least in code-point order of equal ones, if that n is at least twice the word's; else null. root is
    where following forms ends, the word itself if it has none; n_near counts its near words, form_n is the form's n.

    Rows of the same word count together; null and empty words go; other columns don't come back, whatever their names. Words
    may have any length. An empty table gives an empty one.
    """
    vocab = written(vocab.where(F.length("word") > 0).groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    pairs = near_words(vocab).join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").join(vocab, "word")
    best = F.min(F.when(F.col("near_n") >= 2 * F.col("n"), F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))))
    judged = written(pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")), "near-words")
    roots = last_forms(judged.where("best is not null").select("word", F.col("best.form").alias("form")))
    out = vocab.join(judged, "word", "left").join(roots, "word", "left")
    return out.select("word", F.col("best.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.n")).alias("form_n"))


def with_slips(words: DataFrame) -> DataFrame:
    """(doc_id, word) with one code point less where the crc32 of ``<doc_id>:<word>`` is divisible by 97."""
    w = F.col("word")
    code = F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), w).cast("binary"))
    k = (code % F.greatest(F.length(w), F.lit(1))).cast("int")
    return words.select("doc_id", F.when(F.col("doc_id").isNotNull() & (code % 97 == 0), F.concat(F.substring(w, F.lit(1), k), F.substring(w, k + 2, F.length(w)))).otherwise(w).alias("word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spelling_variants(vocabulary(with_slips(word_runs(docs))))


_BYTES = "flatten(list_transform(string_split(doc_id || ':' || word, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195, ord(c)::BIGINT - 64] END))"

#: Words with one code point less meet at its place (replaced), or meet the words themselves (inserted, deleted).
SQL = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
found AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\u00C0-\u00FF]+')) AS word FROM documents),
coded AS (SELECT word, {crc_sql(_BYTES)} AS h FROM found, crc WHERE length(word) >= 5),
slipped AS (SELECT CASE WHEN h % 97 = 0 THEN substr(word, 1, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word FROM coded),
vocabulary AS MATERIALIZED (SELECT word, count(*) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3),
less AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM vocabulary, unnest(range(length(word))) AS u(i)),
near AS MATERIALIZED (SELECT x.word, y.word AS near FROM less AS x JOIN less AS y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT less.word, v.word FROM less JOIN vocabulary AS v ON rest = v.word
  UNION SELECT v.word, less.word FROM less JOIN vocabulary AS v ON rest = v.word),
judged AS MATERIALIZED (SELECT a.word, count(*) AS n_near, arg_min(near, (-b.n, near)) FILTER (b.n >= 2 * a.n) AS form, max(b.n) FILTER (b.n >= 2 * a.n) AS form_n
  FROM near JOIN vocabulary AS a ON a.word = near.word JOIN vocabulary AS b ON b.word = near GROUP BY a.word),
walk AS (SELECT word, form AS last FROM judged WHERE form IS NOT NULL UNION ALL SELECT walk.word, form FROM walk JOIN judged ON judged.word = last WHERE form IS NOT NULL),
ends AS (SELECT walk.word, last FROM walk JOIN judged ON judged.word = last WHERE judged.form IS NULL)
SELECT v.word, form, coalesce(last, v.word) AS root, n, coalesce(n_near, 0) AS n_near, form_n
FROM vocabulary AS v LEFT JOIN judged ON judged.word = v.word LEFT JOIN ends ON ends.word = v.word
"""
