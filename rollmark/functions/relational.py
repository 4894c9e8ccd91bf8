"""Small DataFrame helpers: optional columns, deterministic first rows, checks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def normalize_ids(frame: DataFrame, old: str = "primary_id", new: str = "soldier_id") -> DataFrame:
    return frame if new in frame.columns else frame.withColumnRenamed(old, new)


def require(frame: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in frame.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return frame


def ensure_columns(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add missing columns as nulls of the given types."""
    return frame.withColumns({n: F.lit(None).cast(t) for n, t in columns.items() if n not in frame.columns})


def first_per(frame: DataFrame, keys: Iterable[str], *order: Column) -> DataFrame:
    """The first row of each key in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def top_per(frame: DataFrame, keys: Iterable[str], n: int | Column, *order: Column) -> DataFrame:
    """The first n rows of each key. Spark prunes them before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= n).drop("_nth")


def column_difference(frame: DataFrame, expected: Iterable[str]) -> tuple[list[str], list[str]]:
    """Names that are missing, and names that are not expected."""
    have, want = set(frame.columns), set(expected)
    return sorted(want - have), sorted(have - want)
