"""The four workloads: extraction, rule artifacts, evaluation, synthetic data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotate, artifacts, batching, difficulty, evaluate, extraction, hierarchy, prompts, reconcile, sampling, synth, thresholds
from ..operators.glossary import GlossaryForms
from ..session import stored
from ..sources import tables


def run_extraction(spark: SparkSession, raw_path: str, glossary_path: str, out_path: str, config: extraction.ExtractConfig = extraction.ExtractConfig()) -> DataFrame:
    """Raw records to the canonical table; returns the share of filled rows of each column."""
    raw, missing, _ = tables.read_raw(spark, raw_path)
    if "soldier_id" in missing:
        raise ValueError("raw records need a soldier_id")
    forms = GlossaryForms.of(tables.read_glossary(spark, glossary_path))
    tables.write_table(extraction.canonical_table(raw, forms, config), f"{out_path}/canonical")
    canonical = spark.read.parquet(f"{out_path}/canonical")
    return extraction.filled_shares(canonical, [c for c in canonical.columns if c not in tables.RAW_COLUMNS])


def discriminators(dims: DataFrame) -> dict[str, DataFrame]:
    """Everything that is derived from a hierarchy alone."""
    dims = stored(dims)
    return {
        "levels": hierarchy.level_discriminators(dims),
        "designators": hierarchy.designator_discriminators(dims),
        "depths": hierarchy.depth_discriminators(dims),
        "index": hierarchy.collision_index(dims),
        "rules": hierarchy.exclusion_rules(dims),
    }


def inferred_difficulty(canonical: DataFrame, dims: DataFrame) -> DataFrame:
    dims = stored(dims)
    return difficulty.inferred_difficulty(canonical, dims, stored(hierarchy.collision_index(dims)), stored(hierarchy.exclusion_rules(dims)))


def _patterns(answered: DataFrame) -> DataFrame:
    """component, batch, pos, pattern, means, tier of the patterns in answers."""
    entries = "array<struct<pattern:string,means:string,tier:string>>"
    parsed = artifacts.parse_model(answered, "answer", f"struct<patterns:{entries}>")
    found = parsed.select("component", "batch", F.posexplode(F.coalesce(F.col("parsed.patterns"), F.array().cast(entries))))
    return found.select("component", "batch", "pos", "col.pattern", "col.means", "col.tier")


def generate_artifacts(
    spark: SparkSession,
    validation: DataFrame,
    raw: DataFrame,
    structure: DataFrame,
    designators: DataFrame,
    rules: DataFrame,
    annotator: annotate.Annotator = annotate.mock_annotator,
    samples: int = 20,
    seed: int = 42,
) -> DataFrame:
    """component and artifact, all components at once: thresholds, conflicts, samples, annotated
    patterns of every pair in two passes (the pairs of a component in one order and in the inverted one, each
    prompt with what the pass has found so far), compared, assembled.

    validation: component, soldier_id, level, value. raw: soldier_id, raw_text. structure: component,
    branch, depth, levels. designators: component, level, value. rules: component, rule_type,
    if_contains, if_depth.
    """
    sized = thresholds.component_thresholds(validation, "component", "soldier_id")
    edges = hierarchy.conflict_edges(designators)
    members = validation.select("component", F.col("soldier_id").alias("id"), "level", "value")
    picked = sampling.collision_samples(members, edges, samples, seed)
    texts = picked.join(raw.select(F.col("soldier_id").alias("id"), "raw_text"), "id").groupBy("comp_a", "comp_b", "side").agg(F.array_sort(F.collect_list("raw_text")).alias("texts"))
    wide = texts.groupBy("comp_a", "comp_b").agg(F.first(F.when(F.col("side") == "a", F.col("texts")), True).alias("a"), F.first(F.when(F.col("side") == "b", F.col("texts")), True).alias("b"))
    none = F.array().cast("array<string>")
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    head = prompts.discovery_head(F.col("comp_a"), F.col("comp_b"), a, b)
    asked = wide.select(F.col("comp_a").alias("component"), F.col("comp_b").alias("batch_key"), F.xxhash64("comp_b").alias("batch"), head.alias("head"), F.lit(prompts.DISCOVERY_TAIL).alias("tail"))
    asked = stored(asked)
    # each pass asks once for each pair; what it was told is stored, as every use below reads it
    passes = [stored(annotate.discover(asked, annotator, inverted=i)) for i in (False, True)]
    compared = reconcile.dual_run(*map(_patterns, passes), "component", "batch")
    final = reconcile.final_patterns(compared).select("component", "pattern", "means", "tier")
    vocabulary = final.select("component", F.lower("pattern").alias("term"), F.lit("moderate").alias("strength"))
    diffs = edges.select(F.col("comp_a").alias("component"), F.col("comp_b").alias("rival"), F.concat_ws(" ", "level", "value").alias("rule"))
    diffs = diffs.groupBy("component", "rival").agg(F.array_sort(F.collect_set("rule")).alias("rules")).withColumn("status", F.lit("hierarchy_only"))
    return artifacts.assemble(sized, structure, final, vocabulary, rules, diffs)


def evaluate_strategy(records: DataFrame, mapping: DataFrame, truth: DataFrame, known: DataFrame, annotator: annotate.Annotator = annotate.mock_annotator, levels=("regiment",)) -> DataFrame:
    """split, batch, consolidate, score: metrics of an annotator on the test side of a split.

    records: soldier_id, raw_text. mapping: soldier_id, likely_component. truth: soldier_id, component_id
    and levels. known: component_hint.
    """
    split = sampling.component_split(truth)
    test = split.where("split = 'test'").select("soldier_id")
    packed = batching.component_batches(records, mapping, only=test)
    texts = records.join(packed.select("soldier_id", "batch_id", "component_hint"), "soldier_id").groupBy("batch_id", "component_hint", "soldier_id")
    entities = texts.agg(F.array_sort(F.collect_list("raw_text")).alias("texts")).groupBy("batch_id", "component_hint")
    batches = entities.agg(F.array_sort(F.collect_list(F.struct(F.col("soldier_id").cast("string").alias("id"), "texts"))).alias("entities"))
    none = F.array().cast("array<string>")
    patterns = F.array().cast("array<struct<pattern:string,means:string,tier:string>>")
    batches = batches.withColumn("prompt", prompts.consolidation_prompt(F.col("component_hint"), F.lit(""), patterns, none, none, F.col("entities")))
    answered = annotate.consolidate(batches, annotator, known)
    rows = annotate.parse_batch_answers(answered, ["batch_id"])
    predictions = evaluate.parse_assignments(packed.select(F.col("soldier_id").cast("string").alias("soldier_id")), rows, levels)
    text_truth = truth.withColumn("soldier_id", F.col("soldier_id").cast("string"))
    return evaluate.metrics(predictions, text_truth, levels)


def synthetic_roster(spark: SparkSession, dims: DataFrame, unique_terms: DataFrame, n_soldiers: int, n_sources: int, seed: int = 42) -> dict[str, DataFrame]:
    """people, states, sources and records of a made-up organisation."""
    dims = stored(dims)
    people = synth.soldiers(spark, n_soldiers, seed)
    state = stored(synth.states(people, dims, seed))
    homes = synth.states(synth.soldiers(spark, 40, seed + 1), dims, seed + 1).where("state_order = 1")
    source = synth.sources(spark, n_sources, homes, seed)
    entry = synth.entries(source, state, seed)
    return {"people": people, "states": state, "sources": source, "records": synth.records(entry, unique_terms, seed)}
