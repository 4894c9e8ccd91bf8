"""Parquet, CSV and JSON tables with the checks that readers need."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.relational import column_difference, require

RAW_COLUMNS = ("source_id", "soldier_id", "raw_text")


def read_table(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A Parquet table; a missing one fails here, not in a later job."""
    return require(spark.read.parquet(path), *required)


def read_raw(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], list[str]]:
    """Raw records, the core columns they lack, and those beyond the core."""
    frame = spark.read.parquet(path)
    return frame, *column_difference(frame, RAW_COLUMNS)


def read_optional(spark: SparkSession, path: str | None) -> DataFrame | None:
    """A table that need not be there."""
    from pyspark.errors import AnalysisException

    if path is None:
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def write_table(frame: DataFrame, path: str, form: str = "parquet", by: tuple[str, ...] = ()) -> str:
    """Write a table as Parquet, or as CSV with nested columns as JSON text."""
    if form == "csv":
        nested = {c: F.to_json(F.col(f"`{c}`")) for c, t in frame.dtypes if t.startswith(("array", "map", "struct"))}
        frame.withColumns(nested).write.mode("overwrite").option("header", True).csv(path)
    else:
        frame.write.mode("overwrite").partitionBy(*by).parquet(path) if by else frame.write.mode("overwrite").parquet(path)
    return path


def write_tables(frames: dict[str, DataFrame | None], folder: str, form: str = "parquet") -> dict[str, str]:
    """Write the tables that are there."""
    return {name: write_table(frame, f"{folder}/{name}", form) for name, frame in frames.items() if frame is not None}


def write_metadata(found: DataFrame, existing: DataFrame | None, core: tuple[str, ...], path: str) -> str | None:
    """An existing metadata table as it is, else the columns beyond the core, else nothing."""
    if existing is not None:
        return write_table(existing, path)
    extra = [c for c in found.columns if c not in core]
    keys = [c for c in ("source_id", "soldier_id") if c in found.columns]
    if not extra:
        return None
    return write_table(found.select(*keys, *[f"`{c}`" for c in extra]), path)


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """full_term, abbreviations, term_type of a JSON glossary."""
    frame = spark.read.json(path, multiLine=True).selectExpr("inline(terms)")
    return frame.select(F.col("full term").alias("full_term"), F.col("abbreviations"), F.col("term type").alias("term_type"))


def read_text(spark: SparkSession, path: str) -> str:
    """A small configuration file of any file system that Spark reads."""
    return spark.read.text(path, wholetext=True).head()[0]


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    return hierarchy_rows(spark, json.loads(read_text(spark, path)))


DIM_SCHEMA = "branch string, depth int, level_idx int, level string, value string"


def hierarchy_rows(spark: SparkSession, hierarchy: dict) -> DataFrame:
    """Designator rows of a hierarchy; levels are given by valid_designators or by level_config.

    A level without designators has one row with a null value.
    """
    if "branches" not in hierarchy:
        raise ValueError("the hierarchy has no branches")
    rows = []
    for name, branch in hierarchy["branches"].items():
        levels = branch.get("levels")
        if not levels:
            raise ValueError(f"branch {name} has no levels")
        if "depth" not in branch:
            raise ValueError(f"branch {name} has no depth")
        given = branch.get("valid_designators") or {k: c.get("values", []) for k, c in (branch.get("level_config") or {}).items()}
        for i, level in enumerate(levels):
            for value in given.get(level) or [None]:
                text = None if value is None else str(value).strip()
                rows.append((name, int(branch["depth"]), i, level, str(int(text)) if text and text.isdigit() else text))
    return spark.createDataFrame(rows, DIM_SCHEMA)


def component_rows(spark: SparkSession, hierarchy: dict) -> DataFrame:
    return spark.createDataFrame([(c,) for c in hierarchy.get("components", [])], "component string")


def cross_level_index(spark: SparkSession, hierarchy: dict) -> DataFrame:
    """section, designator, branch, level of a hand-made collision index."""
    rows = []
    for section, entries in (hierarchy.get("collision_index") or {}).items():
        if section in ("numbers", "letters", "names"):
            for designator, places in entries.items():
                for place in places:
                    branch, _, level = place.partition(".")
                    rows.append((section, str(designator), branch, level))
    return spark.createDataFrame(rows, "section string, designator string, branch string, level string")


def unique_terms(spark: SparkSession, hierarchy: dict) -> DataFrame:
    terms = (hierarchy.get("structural_signals") or {}).get("branch_unique_terms") or {}
    return spark.createDataFrame([(b, t) for t, b in terms.items()], "branch string, term string")


# ---- JSON artifacts ----


def discriminators_json(levels: DataFrame, designators: DataFrame, depths: DataFrame, index: DataFrame, rules: DataFrame) -> DataFrame:
    """All discriminators as one JSON text; collision keys as ``(level, "value")``."""
    key = F.format_string("(%s, \"%s\")", "level", "value")

    def listed(frame: DataFrame, entry) -> DataFrame:
        return frame.agg(F.array_sort(F.collect_list(entry)).alias("items"))

    parts = {
        "level_names": listed(levels, F.struct("level", "unique_to", "appears_in")),
        "designators": listed(designators, F.struct("value", "type", "unique_to_branch", "collision_levels")),
        "depths": listed(depths, F.struct("depth", "branches", "is_unique")),
        "collision_index": listed(index, F.struct(key.alias("key"), "members")),
        "branch_exclusion_rules": listed(rules, F.struct("excludes_branch", "rule_order", "rule_type", "condition", "implies_branch", "token", "depth")),
    }
    out = None
    for name, frame in parts.items():
        one = frame.withColumnRenamed("items", name)
        out = one if out is None else out.join(F.broadcast(one))
    return out.select(F.to_json(F.struct(*parts)).alias("discriminators"))


def collision_index_from_json(frame: DataFrame, column: str = "discriminators") -> DataFrame:
    """The collision index of a discriminators JSON; keys that do not parse are left out."""
    from ..functions.text import collision_key

    parsed = F.from_json(F.col(column), "struct<collision_index:array<struct<key:string,members:array<string>>>>")
    rows = frame.select(F.inline(parsed["collision_index"])).withColumn("_key", collision_key(F.col("key"))).where("_key IS NOT NULL")
    return rows.select(F.col("_key.level").alias("level"), F.col("_key.value").alias("value"), "members")


def split_json(split: DataFrame, component: str = "component_id", id_col: str = "soldier_id") -> DataFrame:
    """component and its split as JSON: sorted ids on either side, sizes by stratum."""
    ids = F.struct(
        F.array_sort(F.collect_list(F.when(F.col("split") == "train", F.col(id_col)))).alias("train_ids"),
        F.array_sort(F.collect_list(F.when(F.col("split") == "test", F.col(id_col)))).alias("test_ids"),
    )
    return split.groupBy(component).agg(F.to_json(ids).alias("split_json"))


def split_from_json(frame: DataFrame, component: str = "component_id", id_col: str = "soldier_id") -> DataFrame:
    parsed = F.from_json("split_json", "struct<train_ids:array<string>,test_ids:array<string>>")
    sides = F.array(F.struct(F.lit("train").alias("split"), parsed["train_ids"].alias("ids")), F.struct(F.lit("test").alias("split"), parsed["test_ids"].alias("ids")))
    return frame.select(component, F.inline(sides)).select(component, F.explode("ids").alias(id_col), "split")


def write_artifacts(artifacts: DataFrame, folder: str, component: str = "component") -> str:
    """One JSON text per component, in a folder of its own for each."""
    artifacts.select(component, "artifact").write.mode("overwrite").partitionBy(component).text(folder)
    return folder


def read_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(folder).withColumnRenamed("value", "artifact")


def list_artifacts(spark: SparkSession, folder: str, component: str = "component") -> DataFrame:
    """Components that have an artifact, from the folder's listing alone."""
    return spark.read.text(folder).select(component).distinct().orderBy(component)
