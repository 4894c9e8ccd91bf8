"""Rule artifacts: contradiction filter, grouping, assembly, validation and parsing of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_from_text
from .thresholds import allows_patterns, allows_vocabulary, generation_mode

SECTIONS = ("meta", "structure", "patterns", "vocabulary", "exclusions", "differentiators")


def drop_contradictions(patterns: DataFrame, rules: DataFrame, component: str = "component") -> DataFrame:
    """Patterns whose pattern or means contain no excluded term of their component, without case.

    The terms of a component are one array beside its patterns: texts are searched in place.
    """
    terms = rules.where("if_contains IS NOT NULL").groupBy(component).agg(F.collect_set(F.lower("if_contains")).alias("_terms"))
    joined = patterns.join(terms, component, "left")
    held = F.exists(F.coalesce("_terms", F.array().cast("array<string>")), lambda t: F.contains(F.lower("pattern"), t) | F.contains(F.lower(F.coalesce("means", F.lit(""))), t))
    return joined.where(~held).drop("_terms")


def grouped(frame: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """keys and a map from group to its sorted values (patterns by provenance, vocabulary by strength)."""
    inner = frame.groupBy(*keys, group).agg(F.array_sort(F.collect_set(value)).alias("_values"))
    return inner.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(group, "_values")))).alias("by_group"))


def assemble(
    thresholds: DataFrame,
    structure: DataFrame,
    patterns: DataFrame,
    vocabulary: DataFrame,
    rules: DataFrame,
    differentiators: DataFrame,
    hard_cases: DataFrame | None = None,
    component: str = "component",
) -> DataFrame:
    """component and its artifact as JSON, one row each, without a time stamp.

    thresholds: component, tier, n_entities, pct_of_median. structure: component, branch, depth,
    levels (array). patterns: component, pattern, means, tier. vocabulary: component, term,
    strength. rules: component, rule_type, if_contains, if_depth. differentiators: component, rival,
    status, rules (array).
    """
    t = F.col("tier")
    clean = drop_contradictions(patterns, rules, component)
    entry = F.struct("pattern", "means", F.col("tier").alias("confidence"))
    p = clean.groupBy(component).agg(F.array_sort(F.collect_list(entry)).alias("_patterns"))
    v = grouped(vocabulary, [component], "strength", "term").withColumnRenamed("by_group", "_vocabulary")
    r = rules.groupBy(component).agg(F.array_sort(F.collect_set(F.struct("rule_type", "if_contains", "if_depth"))).alias("_rules"))
    d = differentiators.groupBy(component).agg(F.array_sort(F.collect_list(F.struct("rival", "status", "rules"))).alias("_diffs"))
    out = thresholds.join(structure, component).join(p, component, "left").join(v, component, "left").join(r, component, "left").join(d, component, "left")
    hard = F.lit(0).cast("long")
    if hard_cases is not None:
        out = out.join(hard_cases.groupBy(component).agg(F.count(F.lit(1)).alias("_hard")), component, "left")
        hard = F.coalesce("_hard", F.lit(0).cast("long"))
    status = lambda ok: F.when(ok, "complete").otherwise("not_generated")
    low = t.isin("sparse", "under_represented")
    notes = F.array_compact(
        F.array(
            F.when(t == "sparse", F.lit("Sample size below p25 threshold - limited heuristics available")),
            F.when(t == "sparse", F.lit("Recommend using zero-shot or few-shot strategy")),
            F.when(~allows_patterns(t), F.lit("Pattern discovery not performed due to insufficient data")),
            F.when(~allows_vocabulary(t), F.lit("Vocabulary discovery not performed due to insufficient data")),
        )
    )
    body = F.struct(
        F.struct(
            F.col(component).alias("component_id"), t.alias("tier"), F.col("n_entities").alias("sample_size"), F.round("pct_of_median", 1).alias("pct_of_median"),
            generation_mode(t).alias("generation_mode"), F.when(hard > 0, hard).alias("hard_cases_flagged"),
        ).alias("meta"),
        F.struct(F.lit("complete").alias("status"), "branch", "depth", "levels").alias("structure"),
        F.struct(status(allows_patterns(t)).alias("status"), F.when(allows_patterns(t), F.col("_patterns")).alias("entries")).alias("patterns"),
        F.struct(status(allows_vocabulary(t)).alias("status"), F.when(allows_vocabulary(t), F.col("_vocabulary")).alias("terms")).alias("vocabulary"),
        F.struct(F.col("_rules").alias("structural")).alias("exclusions"),
        F.struct(F.col("_diffs").alias("rivals")).alias("differentiators"),
        F.when(low, notes).alias("quality_notes"),
    )
    return out.select(component, F.to_json(body).alias("artifact"))


def validation_errors(artifacts: DataFrame, column: str = "artifact") -> DataFrame:
    """Add the list of what an artifact lacks; one that does not parse lacks everything."""
    parsed = F.try_parse_json(F.col(column))

    def absent(path: str, text: str) -> Column:
        return F.when(F.try_variant_get(parsed, path, "variant").isNull(), F.lit(text))

    checks = [absent(f"$.{s}", f"Missing required section: {s}") for s in SECTIONS]
    for section, key in (("meta", "component_id"), ("meta", "tier"), ("structure", "status")):
        has = F.try_variant_get(parsed, f"$.{section}", "variant").isNotNull()
        checks.append(F.when(has, absent(f"$.{section}.{key}", f"{section}.{key} is required")))
    return artifacts.withColumn("errors", F.array_compact(F.array(*checks)))


def parse_hard_cases(answers: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """keys, soldier_id, layer, reason of the hard cases in a model's answers; no layer is unknown."""
    schema = "struct<hard_cases:array<struct<soldier_id:string,layer:string,reason:string>>>"
    parsed = F.from_json(json_from_text(F.col(text_col)), schema)
    rows = answers.select(*keys, F.inline(parsed["hard_cases"]))
    return rows.select(*keys, "soldier_id", F.coalesce("layer", F.lit("unknown")).alias("layer"), "reason")


def parse_model(answers: DataFrame, text_col: str, schema: str, strict: bool = False) -> DataFrame:
    """Add the answer parsed to a schema. ``strict`` fails on one that does not parse, else it is null."""
    text = json_from_text(F.col(text_col))
    if strict:
        return answers.withColumn("parsed", F.from_json(F.coalesce(text, F.lit("{")), schema, {"mode": "FAILFAST"}))
    return answers.withColumn("parsed", F.from_json(text, schema, {"mode": "PERMISSIVE"}))


def schema_suffix(schema: str) -> str:
    """What to add to a prompt so that the answer is JSON of a schema."""
    return f"\n\nRespond with JSON only, matching this schema:\n{schema}\n"
