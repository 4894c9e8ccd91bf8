"""Batches under limits. Greedy next-fit packing depends on order, so it is a fold.

The fold of a group runs over sorted batches of Arrow rows with a state of two numbers; rows
arrive sorted by Spark and are never collected. One group is one stream by definition (each
batch depends on the one before), and state stays constant however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..functions.text import token_estimate


def texts_per_entity(records: DataFrame, id_col: str, text_col: str, *order: str) -> DataFrame:
    """id, texts in order, n_records, tokens."""
    sorted_texts = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text_col).alias("_text")))), lambda x: x["_text"])
    return records.groupBy(id_col).agg(sorted_texts.alias("texts"), F.count(F.lit(1)).alias("n_records"), F.sum(token_estimate(F.col(text_col))).alias("tokens"))


def next_fit(
    items: DataFrame, group: str, order: list[Column | str], sizes: dict[str, int], max_items: int | None = None
) -> DataFrame:
    """Add batch (from 0) to items: a new batch begins when one of the sizes would exceed its
    limit, or max_items are in it. An item over a limit gets a batch of its own."""
    names, limits = list(sizes), list(sizes.values())

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count, batch, current = [0] * len(names), 0, 0, object()
        for frame in batches:
            out = []
            for key, *values in frame[["_group_key", *names]].itertuples(index=False, name=None):
                if key != current:
                    held, count, batch, current = [0] * len(names), 0, 0, key
                full = any(h + v > limit for h, v, limit in zip(held, values, limits, strict=True)) or (max_items is not None and count >= max_items)
                if count and full:
                    held, count, batch = [0] * len(names), 0, batch + 1
                held = [h + v for h, v in zip(held, values, strict=True)]
                count += 1
                out.append(batch)
            yield frame.assign(batch=out)

    keyed = items.withColumn("_group_key", F.coalesce(F.col(group).cast("string"), F.lit("")))
    ordered = keyed.repartition("_group_key").sortWithinPartitions("_group_key", *order)
    schema = StructType([*ordered.schema.fields]).add("batch", IntegerType())
    return ordered.mapInPandas(fold, schema).drop("_group_key")


def token_batches(entities: DataFrame, budget: int, group: str | None = None, id_col: str = "soldier_id", inverted: bool = False) -> DataFrame:
    """Entities (id, tokens) packed by tokens, in the order of their ids or its inverse."""
    base = entities if group else entities.withColumn("_all", F.lit("all"))
    order = F.col(id_col).desc() if inverted else F.col(id_col)
    out = next_fit(base, group or "_all", [order], {"tokens": budget})
    return out if group else out.drop("_all")


def component_batches(
    records: DataFrame, mapping: DataFrame | None, id_col: str = "soldier_id", only: DataFrame | None = None, max_entities: int = 50, max_records: int = 500
) -> DataFrame:
    """component_hint, id, n_records, batch, batch_id. Entities without a component are ``unknown``;
    ``only`` filters entities before anything is grouped."""
    base = records.select(id_col)
    if only is not None:
        base = base.join(only.select(id_col), id_col, "left_semi")
    counts = base.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_records"))
    if mapping is not None:
        counts = counts.join(mapping.select(id_col, F.col("likely_component").cast("string").alias("component_hint")), id_col, "left")
    else:
        counts = counts.withColumn("component_hint", F.lit(None).cast("string"))
    counts = counts.withColumn("component_hint", F.coalesce("component_hint", F.lit("unknown")))
    packed = next_fit(counts, "component_hint", [id_col], {"n_records": max_records}, max_items=max_entities)
    return packed.withColumn("batch_id", F.format_string("%s_batch_%03d", "component_hint", "batch"))


def batch_summary(batches: DataFrame, keys: list[str], size: str = "tokens") -> DataFrame:
    """n_batches, total, mean (whole tokens), smallest and largest batch of each group."""
    per_batch = batches.groupBy(*keys, "batch").agg(F.sum(size).alias("_size"))
    grouped = per_batch.groupBy(*keys) if keys else per_batch.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.sum("_size").alias("total"),
        F.floor(F.sum("_size") / F.count(F.lit(1))).cast("long").alias("mean"),
        F.min("_size").alias("smallest"),
        F.max("_size").alias("largest"),
    )
