"""Corpus cleaning as a chain of stages over ``documents``.

Each stage works on all rows that the one before it kept, and is written and read again as
Parquet in between. All stages but the last return the columns of their input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollmark.llm import _common, exact_dedup, near_dedup, packing, quality_classifier, substring_dedup


def _plain(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with columns c0, c1, ..., whatever they are called, and the names of id and text."""
    names = docs.columns
    return docs.toDF(*[f"c{i}" for i in range(len(names))]), f"c{names.index('doc_id')}", f"c{names.index('text')}"


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the weak-label classifier keeps, with all their columns. Texts without words (null ones too) go;
    null ids and repeated rows are judged like any other; of an empty table nothing is left."""
    return quality_classifier.keep_good(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest, then that of the smallest id, a null id last. Null texts
    count as empty. Of rows repeated with one id and text one stays. Of an empty table nothing is left."""
    found = exact_dedup.exact_dedup(docs)
    kept = found.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    plain, doc_id, text = _plain(docs)
    keyed = plain.withColumn("sha", F.sha2(exact_dedup.normalised(F.col(text)), 256))
    out = keyed.join(kept, F.col(doc_id).cast("long").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")), "left_semi")
    repeats = found.where("doc_id IS NULL OR doc_id = keep_id").groupBy("doc_id", "text_sha256").count().where("count > 1")
    if repeats.limit(1).count():
        nth = F.row_number().over(Window.partitionBy(doc_id, "sha").orderBy(F.char_length(text).desc_nulls_last()))
        out = out.withColumn("nth", nth).where("nth = 1").drop("nth")
    return out.drop("sha").toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of one document of each class of near-duplicates: that of the smallest id. Texts without words are
    one class; rows with a null id all stay; rows of one id are one document. Of an empty table nothing is left."""
    kept = near_dedup.near_dedup(docs).where("kept").select(F.col("doc_id").alias("kept_id"))
    plain, doc_id, _ = _plain(docs)
    return plain.join(kept.distinct(), F.col(doc_id).cast("long").eqNullSafe(F.col("kept_id")), "left_semi").toDF(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the words of passages that start in a row of a smaller id; n_chars follows the text.
    A text from which nothing is removed stays as it is, null ones too, and so do rows with a null id."""
    cleaned = substring_dedup.cut_repeats(docs)
    if "n_chars" not in docs.columns:
        return cleaned
    plain, _, text = _plain(cleaned)
    size = f"c{docs.columns.index('n_chars')}"
    return plain.withColumn(size, F.char_length(text).cast(plain.schema[size].dataType)).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts in sequences of 2048 tokens; a null text is the end id alone, an empty table has none."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("substring dedup", cut_repeated_passages),
    ("packing", pack),
]

#: The classifier is fitted by iteration, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{_common.table_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
