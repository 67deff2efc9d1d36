"""A corpus pipeline of five stages: quality rules, near-duplicates, benchmark decontamination, PII, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilelake.llm import bytebpe, decontaminate, neardup, pii, quality
from tilelake.llm.shared import folder


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, in any case of letters."""
    there = {c.lower() for c in docs.columns}
    while name.lower() in there:
        name += "_"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with their columns. Null and empty texts fail the base rules and go; repeated
    rows stay as often as they come; an empty table gives an empty one."""
    out = fresh(docs, "quality")
    return quality.judge(docs, out=out).where(F.col(out)["kept"]).drop(out)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, with its columns: that of least doc_id, null after all others. Rows
    are told apart by a 64-bit hash of all their columns, not by doc_id: other texts under one doc_id and rows without one
    take part for themselves, equal rows are one. Documents without words are no duplicates of others, but equal rows of
    them are. Columns may be maps."""
    row = fresh(docs, "row")
    names = [f"`{c}`" for c in docs.columns]
    plain = [F.to_json(n) if "map<" in docs.schema[c].dataType.simpleString() else F.col(n) for c, n in zip(docs.columns, names, strict=True)]
    rows = docs.withColumn(row, F.xxhash64(*plain, *[F.col(n).isNull() for n in names]))
    classes = neardup.near_duplicates(rows.select("text", row), doc_id=row).select(F.col("doc_id").alias(row), F.col("class_id").alias("class")).distinct()
    named = rows.select(row, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col(row).alias("row")).alias("rank")).join(classes, row)
    least = named.groupBy("class").agg(F.min("rank").alias("least")).select(F.col("least.row").alias(row))
    return rows.join(least, row, "left_semi").dropDuplicates([row]).drop(row)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item, with their columns. Null and empty texts have none and stay; repeated
    rows stay as often as they come; without items all stay."""
    out = fresh(docs, "found")
    found = decontaminate.find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=out)
    return found.where(F.size(F.col(out)["spans"]) == 0).drop(out)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts with pseudonyms; n_chars follows the text where something was found. Null texts stay null;
    equal values get equal pseudonyms in all rows. Without the setting ``spark.tilelake.pii.key`` it warns and takes a
    public key, which does for the invented tables only."""
    out = fresh(docs, "pii")
    made = pii.pseudonymise(docs, pii.secret(spark, pii.TEST_KEY), out=out)
    text, found = F.col(out)["text"], F.col(out)["found"]
    return made.withColumns({"text": text, "n_chars": F.when(F.size(found) > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))}).select(*[f"`{c}`" for c in docs.columns])


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, null as empty, repeated rows each."""
    return bytebpe.digest(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), out="_tokens").select("doc_id", "_tokens.*")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("byte-level BPE", byte_bpe),
]

#: The signatures, pseudonyms and token ids of three stages have no SQL; tests/llm holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{folder(spark)}/stage-{k}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
