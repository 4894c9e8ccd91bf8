"""Extraction, accumulation and late-data windows on streams.

Extraction is stateless, so the batch expressions run on a stream as they are. The accumulator
of patterns keeps the first sight of each key; as a stream it is a deduplication with state per
key. Counts by event-time window are bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.extraction import ExtractConfig, adapt_raw, extract
from ..operators.glossary import GlossaryForms


def extract_stream(raw: DataFrame, forms: GlossaryForms, config: ExtractConfig = ExtractConfig()) -> DataFrame:
    return extract(adapt_raw(raw), forms, config)


def first_seen_patterns(observations: DataFrame, time_col: str, component: str = "component", delay: str = "1 hour") -> DataFrame:
    """The first observation of each pattern of a component; repeats within the delay are dropped and
    state older than it is forgotten."""
    keyed = observations.withColumn("key", F.lower(F.trim("pattern"))).where("key <> ''")
    return keyed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([component, "key"])


def windowed_counts(events: DataFrame, time_col: str, key: str, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events of each key in tumbling windows; later than the delay they are dropped."""
    window = F.window(F.col(time_col), size)
    counted = events.withWatermark(time_col, delay).groupBy(window, F.col(key)).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), key, "n")
