"""Line dedup: lines that many documents share go from all of them but the last.

Lines are exploded with their positions, normalised and hashed; the documents of each hash are counted, the positions of
lines over the threshold are gathered for each document, and its other lines are put together again in order. Built-in
functions only. Keys are known by the 128 bits of their MD5, so the texts themselves are shuffled once, at the end.

One line may be in a third of all documents. Counting it is spread over (line, document) first. Keys with more than a
1024th of the places that are looked for are at most 1024, whatever the size of the tables, so these are broadcast; the
others meet their places in a shuffle in which no key has more than that share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilelake.llm.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\f\r"
#: A key with more than this share of all places is broadcast, so at most so many are.
SHARES = 1024


def _column(name: str) -> Column:
    return F.col(f"`{name}`")


def line_places(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_chars: int = 20) -> DataFrame:
    """(doc, row, pos, key) of each line whose key has at least min_chars code points: the number of the document, the MD5 of
    its text, the place of the line from 0 and the MD5 of the key. The key is the line without ``[\\x20\\x09-\\x0D]`` at both
    ends, A-Z lower-cased."""
    t = F.coalesce(_column(text), F.lit(""))
    lines = docs.select(_column(doc_id).alias("doc"), F.unhex(F.md5(t)).alias("row"), F.posexplode(F.split(F.translate(t, UPPER, LOWER), "\n", -1)).alias("pos", "line"))
    key = F.btrim("line", F.lit(SPACE))
    return lines.where(F.length(key) >= min_chars).select("doc", "row", "pos", F.unhex(F.md5(key)).alias("key"))


def _order(doc: str = "doc") -> Column:
    """Documents in ascending order, those without a number before all others."""
    return F.struct(F.col(doc).isNotNull().alias("numbered"), F.col(doc).alias("doc"))


def common_lines(places: DataFrame, *, min_docs: int = 3) -> DataFrame:
    """(key, n_docs, last) of each key that is in at least min_docs documents; last: the greatest of them."""
    each = places.select("key", "doc").distinct()
    return each.groupBy("key").agg(F.count("*").alias("n_docs"), F.max(_order()).alias("last")).where(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_chars: int = 20, min_docs: int = 3, out: str = "lines") -> DataFrame:
    """docs with a struct ``out``: n_lines, n_dropped and the text without the dropped lines.

    A text is split at ``\\n``. Keys of at least min_chars code points that are in at least min_docs documents lose all
    their lines except in the document of the greatest doc_id; there all its lines stay. Shorter lines stay everywhere.

    Null text is one empty line and comes out as an empty text. Documents are told apart by doc_id: rows of one doc_id are
    one document, so a line that only they have is in one document and stays in each of them; rows without one are one
    document too, before all others. Repeated rows come out as often as they came in. A column of docs named ``out`` is
    replaced; other names don't matter. An empty table gives an empty one.
    """
    docs = docs.drop(out)
    places = written(line_places(docs, text=text, doc_id=doc_id, min_chars=min_chars), "lines")
    common = written(common_lines(places, min_docs=min_docs), "common-lines")
    share = (common.agg(F.sum("n_docs")).first()[0] or 0) / SHARES
    hot = F.broadcast(common.where(F.col("n_docs") > share))
    found = [places.join(hot, "key"), places.join(hot, "key", "left_anti").join(common.where(F.col("n_docs") <= share), "key")]
    gone = found[0].unionByName(found[1]).where(_order() < F.col("last")).groupBy("doc", "row").agg(F.collect_set("pos").alias("gone"))

    t = F.coalesce(_column(text), F.lit(""))
    whole = docs.select(F.struct(*map(_column, docs.columns)).alias("given"), _column(doc_id).alias("id"), F.unhex(F.md5(t)).alias("md5"), t.alias("t"))
    both = whole.join(gone, F.col("id").eqNullSafe(F.col("doc")) & (F.col("md5") == F.col("row")), "left")
    lines = F.split("t", "\n", -1)
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda k: F.get(lines, k)), "\n")
    made = F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("t")).otherwise(kept).alias("text"),
    )
    return both.select("given.*", made.alias(out))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.text", 256).alias("kept_sha256"))


SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM split),
keyed AS (SELECT *, trim(translate(line, '{UPPER}', '{LOWER}'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM line),
common AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT doc_id, pos, line, coalesce(doc_id < last, false) AS gone FROM keyed LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
