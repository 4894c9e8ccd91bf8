"""Predictions against truth, calibration, distributions and costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.relational import first_per
from ..functions.text import safe_ratio, same_text

LEVELS = ("division", "regiment", "battalion", "company")
CONFIDENCES = ("robust", "strong", "moderate", "tentative")


def parse_assignments(batch_ids: DataFrame, answers: DataFrame, levels: Sequence[str] = LEVELS, id_col: str = "soldier_id") -> DataFrame:
    """One row per requested entity: its answer, or a tentative empty one with an error.

    An unknown confidence is tentative; of several answers the first by value counts.
    """
    order = [F.col(c).cast("string") for c in ("confidence", *levels)]
    one = first_per(answers, [id_col], *order).withColumn("_answered", F.lit(True))
    joined = batch_ids.select(id_col).distinct().join(one, id_col, "left")
    confidence = F.when(F.lower("confidence").isin(*CONFIDENCES), F.lower("confidence")).otherwise("tentative")
    return joined.select(id_col, *levels, confidence.alias("confidence"), F.col("_answered").isNull().alias("has_error"))


def scored(predictions: DataFrame, truth: DataFrame, levels: Sequence[str] = LEVELS, id_col: str = "soldier_id", component: str = "component_id") -> DataFrame:
    """One row per prediction with a truth: cascading matches, each level needs all above it."""
    p = predictions.select(id_col, "confidence", "has_error", *[F.col(c).alias(f"p_{c}") for c in levels])
    joined = p.join(truth.select(id_col, component, *levels), id_col)
    out: dict[str, Column] = {}
    so_far: Column = ~F.col("has_error")
    for level in levels:
        so_far = so_far & same_text(F.col(f"p_{level}"), F.col(level))
        out[f"{level}_ok"] = so_far
    return joined.withColumns(out).select(id_col, component, "confidence", "has_error", *[f"{x}_ok" for x in levels])


def metrics(predictions: DataFrame, truth: DataFrame, levels: Sequence[str] = LEVELS, id_col: str = "soldier_id", component: str = "component_id") -> DataFrame:
    """Overall, per component and per confidence in one pass (grouping sets).

    scope is overall, component or confidence; name its value. Accuracy is over predictions
    without errors; total_entities counts the truth of the scope.
    """
    rows = scored(predictions, truth, levels, id_col, component)
    counts = [F.count(F.lit(1)).alias("n_predictions"), F.count_if("has_error").alias("n_errors"), *[F.count_if(f"{x}_ok").alias(f"{x}_correct") for x in levels]]
    grouped = rows.groupingSets([[], [F.col(component)], [F.col("confidence")]], component, "confidence").agg(F.grouping_id().alias("_g"), *counts)
    # grouping id bits: component, confidence; a set bit is rolled up
    scope = F.when(F.col("_g") == 3, "overall").when(F.col("_g") == 1, "component").otherwise("confidence")
    name = F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, F.col(component).cast("string")).otherwise(F.col("confidence"))
    named = grouped.select(scope.alias("scope"), name.alias("name"), *[c for c in grouped.columns if c not in ("_g", component, "confidence")])
    per = truth.groupBy(F.col(component).cast("string").alias("name")).agg(F.count_distinct(id_col).alias("total_entities")).withColumn("scope", F.lit("component"))
    whole = truth.agg(F.count_distinct(id_col).alias("total_entities")).select(F.lit("all").alias("name"), "total_entities", F.lit("overall").alias("scope"))
    totals = per.unionByName(whole)
    joined = named.join(totals, ["scope", "name"], "left")
    valid = F.col("n_predictions") - F.col("n_errors")
    return joined.withColumns(
        {f"{x}_accuracy": safe_ratio(F.col(f"{x}_correct"), valid) for x in levels}
        | {"error_rate": safe_ratio(F.col("n_errors"), F.col("n_predictions")), "coverage": safe_ratio(F.col("n_predictions"), F.col("total_entities"))}
    )


def missing_predictions(predictions: DataFrame, truth: DataFrame, id_col: str = "soldier_id") -> DataFrame:
    return truth.select(id_col).distinct().join(predictions.select(id_col), id_col, "left_anti")


def calibration(predictions: DataFrame, truth: DataFrame, levels: Sequence[str] = LEVELS, id_col: str = "soldier_id", component: str = "component_id") -> DataFrame:
    """confidence, total, correct, accuracy for all four confidences; errors do not count."""
    rows = scored(predictions, truth, levels, id_col, component).where("NOT has_error")
    last = f"{levels[-1]}_ok"
    counts = rows.groupBy("confidence").agg(F.count(F.lit(1)).alias("total"), F.count_if(last).alias("correct"))
    every = rows.sparkSession.createDataFrame([(c,) for c in CONFIDENCES], "confidence string")
    joined = every.join(counts, "confidence", "left")
    return joined.select("confidence", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("correct", F.lit(0)).alias("correct")).withColumn(
        "accuracy", safe_ratio(F.col("correct"), F.col("total"))
    )


def largest_components(truth: DataFrame, n: int = 5, id_col: str = "soldier_id", component: str = "component_id") -> DataFrame:
    """The n largest components: a top-k report."""
    sizes = truth.groupBy(component).agg(F.count_distinct(id_col).alias("n_entities"))
    return sizes.orderBy(F.col("n_entities").desc(), component).limit(n)


def distribution(frame: DataFrame, column: str, targets: dict[str, float], tolerance: float = 0.05) -> DataFrame:
    """value, n, share, target, state (over, under or within) for all targeted values."""
    spark = frame.sparkSession
    counts = frame.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = frame.agg(F.count(F.lit(1)).alias("total"))
    every = spark.createDataFrame([(k, float(v)) for k, v in targets.items()], "value string, target double")
    joined = every.join(counts, "value", "left").join(F.broadcast(total))
    share = safe_ratio(F.coalesce("n", F.lit(0)), F.col("total"))
    off = share - F.col("target")
    state = F.when(off > tolerance, "over").when(off < -tolerance, "under").otherwise("within")
    return joined.select("value", F.coalesce("n", F.lit(0)).alias("n"), share.alias("share"), "target", state.alias("state"))


def adjustment_candidates(frame: DataFrame, column: str, report: DataFrame, id_col: str = "soldier_id") -> DataFrame:
    """The first half of the entities, by id, in values that are over their target."""
    from pyspark.sql import Window

    over = report.where("state = 'over'").select(F.col("value").alias(column), F.col("n").alias("_n"))
    w = Window.partitionBy(column).orderBy(id_col)
    ranked = frame.select(id_col, column).join(over, column).withColumn("_nth", F.row_number().over(w))
    return ranked.where(F.col("_nth") <= F.floor(F.col("_n") / 2)).select(id_col, column)


def majority(frame: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the first seen."""
    counts = frame.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("_first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("n"), -F.col("_first"))).alias(value), F.max("n").alias("n"))


def cost(calls: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, tokens, seconds and dollars of each key. prices: model, input_price, output_price per
    million tokens; an unknown model costs nothing."""
    joined = calls.join(F.broadcast(prices), "model", "left")
    dollars = F.col("input_tokens") / 1e6 * F.coalesce("input_price", F.lit(0.0)) + F.col("output_tokens") / 1e6 * F.coalesce("output_price", F.lit(0.0))
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum(dollars), 6).alias("cost_usd"),
    )
