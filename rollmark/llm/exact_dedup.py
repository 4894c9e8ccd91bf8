"""Exact deduplication by skew-safe combining, in DataFrame functions only.

1. Every text gets the SHA-256 of its normalised form (white space deleted). The narrow
   table (row number, id, length, digest) is written once to the shared folder.
2. Digests that hold a large share of all rows are found by a partial and a final count.
   At most ``hot_share`` digests can hold ``1 / hot_share`` of the rows each, so this list
   has a proven bound and is broadcast.
3. Rows are merged by (digest, full normalised text, salt). The partial aggregate of each
   map task is the local deduplication, the shuffled one merges the salted groups; only
   hot digests are salted (by map task), every other group is final here.
4. The salt winners of hot digests are combined globally, again by digest and full text.
5. The narrow table is joined with the winners; Spark's adaptive skew join splits the
   rows of a hot digest.

Winner and count travel as one number each, so all three merges are hash aggregates.
Two different texts with one digest are found (their digest has two winners) and told
apart by their full text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACE_CLASS, documents, quoted, saved, text_or_empty

#: Order key of a row: (2^31 - 1 - length) * 2^65 + (id + 2^63), a null id counts as 2^64.
_LENGTH_LIMIT = 2**31 - 1
_ID_SPAN = 2**65
_ID_ZERO = 2**63
_NULL_ID = 2**64


def _wide(value: int):
    return F.lit(str(value)).cast("decimal(38,0)")


def normalised(text):
    return F.regexp_replace(text_or_empty(text), SPACE_CLASS + "+", "")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    hot_share: int = 1000,
    digest_chars: int = 64,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deletion of ASCII white space. Of equal texts the
    one with most code points in its original form stays, then the smallest id.

    Null texts count as empty, and all empty texts are one group. A null id sorts after
    all others. Of rows repeated with the same id and text exactly one is kept. An empty
    table gives an empty result; other columns are ignored, whatever their names.
    ``digest_chars`` shortens the digest that groups rows (tests force collisions by it).
    """
    source = docs.select(quoted(id_col).cast("long").alias("doc_id"), text_or_empty(quoted(text_col)).alias("text"))
    norm = normalised(F.col("text"))
    order = (_wide(_LENGTH_LIMIT) - F.char_length("text").cast("decimal(10,0)")) * _wide(_ID_SPAN).cast("decimal(20,0)") + F.coalesce(
        F.col("doc_id").cast("decimal(20,0)") + _wide(_ID_ZERO), _wide(_NULL_ID)
    )
    order = order.cast("decimal(38,0)")
    sha = F.unhex(F.sha2(norm, 256))
    group = F.unhex(F.substring(F.sha2(norm, 256), 1, digest_chars))

    rows = saved(
        source.select(
            F.monotonically_increasing_id().alias("uid"), "doc_id", order.alias("order_key"), sha.alias("sha"), group.alias("digest")
        )
    )
    total = rows.count()
    hot = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("n") * hot_share >= total))
    hot = hot.select(F.col("digest").alias("hot_digest"))

    texts = source.select(group.alias("digest"), norm.alias("norm"), order.alias("order_key"))
    merge = [F.min("order_key").alias("order_key"), F.sum("n").alias("n")]
    texts = texts.withColumn("n", F.lit(1).cast("long"))
    cold_winners = (
        texts.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left_anti").groupBy("digest", "norm").agg(*merge)
    )
    hot_winners = (
        texts.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left_semi")
        .withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "norm", "salt")
        .agg(*merge)
        .groupBy("digest", "norm")
        .agg(*merge)
    )
    winners = cold_winners.unionByName(hot_winners)
    winners = saved(winners.select("digest", F.unhex(F.sha2("norm", 256)).alias("sha"), "order_key", F.col("n").alias("group_size")))
    if digest_chars < 64:
        keys = ["digest", "sha"]
    else:
        clash = winners.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        if clash:
            raise ValueError("two different texts share a SHA-256 digest")
        keys = ["digest"]
        winners = winners.drop("sha")

    found = rows.join(winners.withColumnRenamed("order_key", "best"), keys, "inner")
    found = found.withColumn("wins", F.col("order_key") == F.col("best"))
    # rows repeated with the same id and text tie; the first of them stays
    repeats = rows.groupBy("sha", "doc_id").agg(F.count(F.lit(1)).alias("tied"), F.min("uid").alias("first_uid")).where("tied > 1")
    repeats = saved(repeats.select(F.col("sha").alias("sha_"), F.col("doc_id").alias("id_"), "first_uid"))
    if repeats.limit(1).count():
        found = found.join(repeats, (F.col("sha") == F.col("sha_")) & F.col("doc_id").eqNullSafe(F.col("id_")), "left")
    else:
        found = found.withColumn("first_uid", F.lit(None).cast("long"))
    low = F.col("best") % _wide(_ID_SPAN)
    return found.select(
        "doc_id",
        F.when(low < _wide(_NULL_ID), (low - _wide(_ID_ZERO)).cast("long")).alias("keep_id"),
        "group_size",
        (F.col("wins") & (F.col("first_uid").isNull() | (F.col("uid") == F.col("first_uid")))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
), w AS (
  SELECT doc_id, n,
         first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY n) AS group_size
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM w
"""
