"""Component sizes, tiers and the rebuild registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIERS = ("sparse", "under_represented", "adequately_represented", "well_represented")
#: Tiers whose artifacts may hold patterns, and vocabulary.
PATTERN_TIERS = ("well_represented", "adequately_represented", "under_represented")
VOCABULARY_TIERS = ("well_represented", "adequately_represented")
#: Share of the median from which a small component is under-represented, not sparse.
PCT_GUARD = 75.0


def component_counts(validation: DataFrame, component: str = "component_id", id_col: str = "soldier_id") -> DataFrame:
    """Distinct entities of each component."""
    return validation.where(F.col(component).isNotNull()).groupBy(component).agg(F.count_distinct(id_col).alias("n_entities"))


def quantiles(counts: DataFrame) -> DataFrame:
    """p25, median, p75 of the component sizes, interpolated; one row."""
    q = F.percentile("n_entities", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return counts.agg(q.alias("q")).select(F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"))


def pct_of_median(count: Column, median: Column) -> Column:
    return F.when(median == 0, 0.0).otherwise(count / median * 100)


def tier(count: Column, p25: Column, median: Column, p75: Column) -> Column:
    return (
        F.when(count >= p75, "well_represented")
        .when(count >= median, "adequately_represented")
        .when((count >= p25) | (pct_of_median(count, median) >= PCT_GUARD), "under_represented")
        .otherwise("sparse")
    )


def component_thresholds(validation: DataFrame, component: str = "component_id", id_col: str = "soldier_id") -> DataFrame:
    """component, n_entities, p25, median, p75, pct_of_median, tier. The one row of quantiles is broadcast."""
    counts = component_counts(validation, component, id_col)
    joined = counts.join(F.broadcast(quantiles(counts)))
    return joined.withColumns(
        {
            "pct_of_median": pct_of_median(F.col("n_entities"), F.col("median")),
            "tier": tier(F.col("n_entities"), F.col("p25"), F.col("median"), F.col("p75")),
        }
    )


def tier_histogram(thresholds: DataFrame) -> DataFrame:
    """tier and its number of components, for all four tiers."""
    counts = thresholds.agg(*[F.count_if(F.col("tier") == t).alias(t) for t in TIERS])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(t).alias("tier"), F.col(t).alias("n_components")) for t in TIERS])))


def allows_patterns(tier: Column) -> Column:
    return tier.isin(*PATTERN_TIERS)


def allows_vocabulary(tier: Column) -> Column:
    return tier.isin(*VOCABULARY_TIERS)


def allows_value_exclusions(tier: Column) -> Column:
    """No tier does: exclusions by value are not mined."""
    return tier.isNotNull() & F.lit(False)


def generation_mode(tier: Column) -> Column:
    return F.when(tier.isin("well_represented", "adequately_represented"), "full").when(tier == "under_represented", "limited").otherwise("hierarchy_only")


def section_status(tier: Column) -> Column:
    """What becomes of each section of an artifact of a tier."""
    full = tier.isin("well_represented", "adequately_represented")
    return F.struct(
        F.lit("complete").alias("structure"),
        F.when(full, "complete").when(tier == "under_represented", "limited").otherwise("not_generated").alias("patterns"),
        F.when(full, "complete").otherwise("not_generated").alias("vocabulary"),
        F.lit("complete").alias("exclusions_structural"),
        F.lit("not_applicable").alias("exclusions_value_based"),
        F.when(full, "complete").otherwise("hierarchy_only").alias("differentiators"),
    )


#: What to tell users of an artifact of a low tier (fixed values).
ADVICE = {
    "sparse": (
        "Consider using zero-shot or few-shot strategy for this component",
        "Resolver provides hierarchy-only guidance",
        "High collision risk with similar components",
    ),
    "under_represented": (
        "Pattern and vocabulary sections are limited",
        "Differentiators are hierarchy-based only",
        "Consider supplementing with few-shot examples",
    ),
}


def recommendations(tier: Column) -> Column:
    out = F.array().cast("array<string>")
    for name, texts in ADVICE.items():
        out = F.when(tier == name, F.array(*map(F.lit, texts))).otherwise(out)
    return out


def warnings(tier: Column, pct: Column) -> Column:
    sparse = tier == "sparse"
    return F.array_compact(
        F.array(
            F.when(sparse, F.format_string("Sample size is only %.1f%% of median", pct)),
            F.when(sparse, F.lit("Pattern discovery not performed due to insufficient data")),
            F.when(pct < 50, F.lit("Component significantly underrepresented in validation data")),
        )
    )


def registry_entries(thresholds: DataFrame, component: str = "component_id") -> DataFrame:
    """What a registry keeps of each component, and when it asks for a rebuild: at the next tier,
    or at the size (p25, or median) that reaches it."""
    t = F.col("tier")
    trigger = F.when(t == "sparse", "under_represented").when(t == "under_represented", "adequately_represented")
    size = F.when(t == "sparse", F.col("p25").cast("int")).when(t == "under_represented", F.col("median").cast("int"))
    return thresholds.select(
        component,
        "tier",
        F.col("n_entities").alias("sample_size"),
        F.round("pct_of_median", 1).alias("pct_of_median"),
        generation_mode(t).alias("generation_mode"),
        section_status(t).alias("sections"),
        trigger.alias("rebuild_when_tier"),
        size.alias("rebuild_when_sample_size"),
        recommendations(t).alias("recommendations"),
        warnings(t, F.col("pct_of_median")).alias("warnings"),
    )


def rebuild_candidates(thresholds: DataFrame, registry: DataFrame, component: str = "component_id") -> DataFrame:
    """component, reason: new ones, and those that reached the tier or size their entry waits for."""
    order = F.array(*map(F.lit, TIERS))
    known = registry.select(component, "rebuild_when_tier", "rebuild_when_sample_size", F.lit(True).alias("known"))
    joined = thresholds.join(known, component, "left")
    reached = F.array_position(order, F.col("tier")) >= F.array_position(order, F.col("rebuild_when_tier"))
    reason = (
        F.when(F.col("known").isNull(), "new")
        .when(F.coalesce(reached, F.lit(False)), "tier")
        .when(F.coalesce(F.col("n_entities") >= F.col("rebuild_when_sample_size"), F.lit(False)) & (F.col("rebuild_when_sample_size") > 0), "size")
    )
    return joined.select(component, reason.alias("reason")).where("reason IS NOT NULL")
