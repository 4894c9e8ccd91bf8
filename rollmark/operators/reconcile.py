"""Comparison of two runs, deduplicated accumulation, hard cases and verdict overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.relational import first_per

#: Layers a hard case may be flagged in (fixed values).
LAYERS = ("collision_position", "complementarity", "structural_ambiguity", "unknown")


def pattern_key(pattern: Column) -> Column:
    return F.lower(F.trim(pattern))


def dedupe_patterns(patterns: DataFrame, keys: list[str], position: str = "pos") -> DataFrame:
    """The first of patterns equal without case."""
    keyed = patterns.withColumn("_key", F.lower("pattern"))
    return first_per(keyed, [*keys, "_key"], F.col(position), F.col("pattern")).drop("_key")


def _last_by_key(patterns: DataFrame, keys: list[str], position: str) -> DataFrame:
    keyed = patterns.withColumn("key", pattern_key(F.col("pattern"))).where("key <> ''")
    return first_per(keyed, [*keys, "key"], F.col(position).desc())


def compare_runs(forward: DataFrame, inverted: DataFrame, keys: list[str] | None = None, position: str = "pos") -> DataFrame:
    """Full outer join of two runs' patterns by key; of repeats within a run the last counts.

    Patterns of both runs are robust, of one are order_dependent and tentative. Attributes of the
    forward run are preferred. Input columns: keys, pos, pattern, means, tier.
    """
    keys = keys or []
    f = _last_by_key(forward, keys, position).select(*keys, "key", *[F.col(c).alias(f"f_{c}") for c in ("pattern", "means", "tier")], F.lit(True).alias("f"))
    i = _last_by_key(inverted, keys, position).select(*keys, "key", *[F.col(c).alias(f"i_{c}") for c in ("pattern", "means", "tier")], F.lit(True).alias("i"))
    joined = f.join(i, [*keys, "key"], "full_outer")
    in_f, in_i = F.coalesce("f", F.lit(False)), F.coalesce("i", F.lit(False))
    both = in_f & in_i
    return joined.select(
        *keys,
        "key",
        F.when(in_f, F.col("f_pattern")).otherwise(F.col("i_pattern")).alias("pattern"),
        F.when(in_f, F.col("f_means")).otherwise(F.col("i_means")).alias("means"),
        in_f.alias("in_forward"),
        in_i.alias("in_inverted"),
        F.col("f_tier").alias("forward_confidence"),
        F.col("i_tier").alias("inverted_confidence"),
        F.when(both, "robust").otherwise("order_dependent").alias("status"),
        F.when(both, F.coalesce("f_tier", "i_tier")).otherwise("tentative").alias("final_confidence"),
    )


def robust_patterns(compared: DataFrame) -> DataFrame:
    return compared.where("in_forward AND in_inverted")


def overlay_verdicts(compared: DataFrame, verdicts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Verdicts (pattern, status, confidence, notes) override the comparison where they have one."""
    keys = keys or []
    v = first_per(verdicts.withColumn("key", pattern_key(F.col("pattern"))), [*keys, "key"], F.col("status"), F.col("confidence"))
    v = v.select(*keys, "key", F.col("status").alias("v_status"), F.col("confidence").alias("v_confidence"), F.col("notes").alias("notes"))
    joined = compared.join(v, [*keys, "key"], "left")
    return joined.withColumns({"status": F.coalesce("v_status", "status"), "final_confidence": F.coalesce("v_confidence", "final_confidence")}).drop("v_status", "v_confidence")


def overlay_tiers(patterns: DataFrame, validated: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Validated patterns (pattern, tier, provenance) update tier and provenance."""
    keys = keys or []
    v = first_per(validated.withColumn("_key", pattern_key(F.col("pattern"))), [*keys, "_key"], F.col("tier"))
    v = v.select(*keys, "_key", F.col("tier").alias("v_tier"), F.col("provenance").alias("v_provenance"))
    joined = patterns.withColumn("_key", pattern_key(F.col("pattern"))).join(v, [*keys, "_key"], "left")
    return joined.withColumns({"tier": F.coalesce("v_tier", "tier"), "provenance": F.coalesce("v_provenance", "provenance")}).drop("_key", "v_tier", "v_provenance")


def final_patterns(compared: DataFrame) -> DataFrame:
    """Robust ones (strong by default) and validated ones (moderate by default)."""
    default = F.when(F.col("status") == "robust", "strong").otherwise("moderate")
    return compared.where(F.col("status").isin("robust", "validated")).withColumn("tier", F.coalesce("final_confidence", default))


def flagged_patterns(compared: DataFrame) -> DataFrame:
    return compared.where("status = 'order_dependent'").withColumn("tier", F.lit("tentative"))


def hard_case_agreement(forward: DataFrame, inverted: DataFrame, id_col: str = "soldier_id") -> DataFrame:
    """id and whether both runs flag it, or one only."""
    flags = forward.select(id_col, F.lit(1).alias("f"), F.lit(0).alias("i")).unionByName(inverted.select(id_col, F.lit(0).alias("f"), F.lit(1).alias("i")))
    grouped = flags.groupBy(id_col).agg(F.max("f").alias("f"), F.max("i").alias("i"))
    word = F.when((F.col("f") == 1) & (F.col("i") == 1), "both").when(F.col("f") == 1, "forward_only").otherwise("inverted_only")
    return grouped.select(id_col, word.alias("flagged_in"))


def all_hard_cases(forward: DataFrame, inverted: DataFrame, id_col: str = "soldier_id") -> DataFrame:
    """Rows of the forward run, then those only the inverted run has, labelled."""
    merged = forward.unionByName(inverted.join(forward.select(id_col), id_col, "left_anti"))
    return merged.join(hard_case_agreement(forward, inverted, id_col), id_col)


def hard_cases_by_layer(cases: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts in four layers; an unknown or null layer is ``unknown``."""
    layer = F.when(F.col("layer").isin(*LAYERS), F.col("layer")).otherwise("unknown")
    named = cases.withColumn("_layer", layer)
    return named.groupBy(*(keys or [])).agg(*[F.count_if(F.col("_layer") == x).alias(x) for x in LAYERS])


def ids_by_layer(cases: DataFrame, id_col: str = "soldier_id", keys: list[str] | None = None) -> DataFrame:
    layer = F.when(F.col("layer").isin(*LAYERS), F.col("layer")).otherwise("unknown").alias("layer")
    return cases.groupBy(*(keys or []), layer).agg(F.array_sort(F.collect_set(id_col)).alias("ids"))


def case_records(cases: DataFrame, records: DataFrame, id_col: str, text_col: str, *order: str, most: int = 5) -> DataFrame:
    """Each hard case with its first texts."""
    wanted = records.join(cases.select(id_col).distinct(), id_col, "left_semi")
    texts = F.transform(F.slice(F.array_sort(F.collect_list(F.struct(*order, F.col(text_col).alias("_t")))), 1, most), lambda x: x["_t"])
    return wanted.groupBy(id_col).agg(texts.alias("texts"))


def accumulate(observations: DataFrame, component: str, batch: str, inverted: bool = False) -> DataFrame:
    """What an accumulator knows after all batches of a component: each pattern once, with the
    batch that first saw it, in forward or inverted order. Observations are component, batch,
    pos, pattern, means. The fold keeps the first of each key, so it is a minimum over the
    order of batches; a failed batch has no rows and changes nothing."""
    order = -F.col(batch) if inverted else F.col(batch)
    keyed = observations.withColumn("_key", pattern_key(F.col("pattern"))).where("_key <> ''")
    first = first_per(keyed, [component, "_key"], order, F.col("pos"))
    return first.select(component, F.col("_key").alias("key"), "pattern", "means", F.col(batch).alias("first_batch"))


def dual_run(forward: DataFrame, inverted: DataFrame, component: str, batch: str) -> DataFrame:
    """The folds over the observations of two passes, the second over the batches in inverted order, and their comparison."""
    runs = [
        accumulate(rows, component, batch, inverted=i).withColumn("tier", F.lit(None).cast("string")).withColumn("pos", F.col("first_batch"))
        for rows, i in ((forward, False), (inverted, True))
    ]
    return compare_runs(*runs, keys=[component])
