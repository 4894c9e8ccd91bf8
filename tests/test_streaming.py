"""Streams over files, run until they are used up."""

from pyspark.sql import functions as F

from rollmark.operators.glossary import GlossaryForms
from rollmark.streaming import incremental


def collected(frame, name, spark, path, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", path).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_extraction_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("s", "Fleet 3"), ("t", "nothing")], "soldier_id string, raw_text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("soldier_id string, raw_text string").parquet(f"{tmp_path}/in")
    out = incremental.extract_stream(stream, GlossaryForms().add("fleet", [], "Unit Term")).select("soldier_id", F.col("`Unit_Term_Digit_Term:Pair`").alias("pairs"))
    assert {r["soldier_id"]: r["pairs"] for r in collected(out, "extracted", spark, f"{tmp_path}/c")} == {"s": ["FLEET:3"], "t": []}


def test_first_seen_patterns(spark, tmp_path):
    rows = [("c", "A", 1), ("c", "a ", 2), ("d", "a", 1), ("c", " ", 1)]
    spark.createDataFrame(rows, "component string, pattern string, s long").withColumn("at", F.timestamp_seconds("s")).drop("s").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("component string, pattern string, at timestamp").parquet(f"{tmp_path}/in")
    got = collected(incremental.first_seen_patterns(stream, "at"), "patterns", spark, f"{tmp_path}/c")
    assert sorted((r["component"], r["key"]) for r in got) == [("c", "a"), ("d", "a")]


def test_windowed_counts(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (2, "x"), (4000, "x")], "s long, k string").select(F.timestamp_seconds("s").alias("at"), "k").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("at timestamp, k string").parquet(f"{tmp_path}/in")
    got = collected(incremental.windowed_counts(stream, "at", "k"), "counts", spark, f"{tmp_path}/c", "complete")
    assert sorted(r["n"] for r in got) == [1, 2]
