"""Splits, top-n by quality, quota samples and collision samples.

Random choices order rows by the MD5 of (seed, id): the same in every run and every SQL
engine, and independent of partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.relational import first_per, require, top_per
from ..functions.text import hash_order, hash_unit

TIERS = ("extreme", "hard", "moderate", "easy")


# ---- splits ----


def stratified_split(
    frame: DataFrame,
    component: str = "component_id",
    stratum: str = "regiment",
    id_col: str = "soldier_id",
    test_ratio: float = 0.2,
    seed: int = 42,
    min_test_per_component: int = 10,
    min_stratum: int = 4,
    min_test_per_stratum: int = 1,
    distinct: bool = True,
) -> DataFrame:
    """component, stratum, id, split. Small components and strata are all train.

    By default each entity counts once, in its smallest stratum, so no entity is on both sides.
    ``distinct=False`` counts rows as they are. Null strata take no part.
    """
    rows = require(frame, component, stratum, id_col).select(component, stratum, id_col).where(F.col(stratum).isNotNull() & F.col(component).isNotNull())
    if distinct:
        rows = rows.groupBy(component, id_col).agg(F.min(stratum).alias(stratum))
    in_component = rows.groupBy(component).agg(F.count(F.lit(1)).alias("_component_n"))
    in_stratum = rows.groupBy(component, stratum).agg(F.count(F.lit(1)).alias("_n"))
    sizes = in_stratum.join(in_component, component)
    target = F.greatest(F.lit(min_test_per_stratum), F.floor(F.col("_n") * F.lit(test_ratio) + 1e-9).cast("int"))
    test = F.when((F.col("_component_n") < min_test_per_component) | (F.col("_n") < min_stratum), 0).otherwise(F.least(target, F.col("_n") - 1))
    w = Window.partitionBy(component, stratum).orderBy(hash_order(seed, F.col(id_col)), F.col(id_col))
    numbered = rows.withColumn("_nth", F.row_number().over(w)).join(sizes.withColumn("_test", test), [component, stratum])
    return numbered.select(component, stratum, id_col, F.when(F.col("_nth") <= F.col("_test"), "test").otherwise("train").alias("split"))


def component_split(frame: DataFrame, component: str = "component_id", id_col: str = "soldier_id", train_ratio: float = 0.7, seed: int = 42) -> DataFrame:
    """component, id, split: half-even rounded share of each component, at least one on either side."""
    ids = frame.select(component, id_col).where(F.col(id_col).isNotNull() & F.col(component).isNotNull()).distinct()
    sizes = ids.groupBy(component).agg(F.count(F.lit(1)).alias("_n"))
    test = F.when(F.col("_n") < 2, 0).otherwise(F.greatest(F.lit(1), F.least(F.rint(F.round(F.col("_n") * (1 - train_ratio), 9)).cast("int"), F.col("_n") - 1)))
    w = Window.partitionBy(component).orderBy(hash_order(seed, F.col(id_col)), F.col(id_col))
    numbered = ids.withColumn("_nth", F.row_number().over(w)).join(sizes.withColumn("_test", test), component)
    return numbered.select(component, id_col, F.when(F.col("_nth") <= F.col("_test"), "test").otherwise("train").alias("split"))


def with_difficulty(validation: DataFrame, difficulty: DataFrame, id_col: str = "soldier_id") -> DataFrame:
    """validation left-joined with the first difficulty row of each entity."""
    order = [F.col(c).cast("string") for c in sorted(difficulty.columns) if c != id_col]
    return validation.join(first_per(difficulty, [id_col], *(order or [F.lit(1)])), id_col, "left")


def rows_of(frame: DataFrame, ids: DataFrame, id_col: str = "soldier_id") -> DataFrame:
    """Rows whose id is among ids."""
    return frame.join(ids.select(id_col), id_col, "left_semi")


def leakage(split: DataFrame, id_col: str = "soldier_id") -> DataFrame:
    """Entities that are on both sides of a split."""
    return split.groupBy(id_col).agg(F.count_distinct("split").alias("sides")).where("sides > 1").select(id_col)


# ---- top-n by quality ----


def quality_vocab(records: DataFrame, keys: list[str], n: int = 40, tier: str = "quality_tier", *position: Column) -> DataFrame:
    """At most n records of each key, the lowest quality (tier 5) first, stable within a tier."""
    return top_per(records.where(F.col(tier).between(1, 5)), keys, n, F.col(tier).desc(), *position)


def quality_differentiator(records: DataFrame, keys: list[str], n: int = 40, tier: str = "quality_tier", *position: Column) -> DataFrame:
    """Tiers 5, 4, 3 first; of tier 2 at most a fifth of n; tier 1 never. Keys without tiers 3
    to 5 take up to a fifth of n of tier 2."""
    limit = max(1, int(n * 0.2))
    w = Window.partitionBy(*keys)
    by_tier = Window.partitionBy(*keys, tier).orderBy(*position)
    ranked = records.where(F.col(tier).between(2, 5)).withColumn("_in_tier", F.row_number().over(by_tier))
    ranked = ranked.where((F.col(tier) > 2) | (F.col("_in_tier") <= limit))
    ranked = ranked.withColumn("_nth", F.row_number().over(w.orderBy(F.col(tier).desc(), "_in_tier")))
    return ranked.where(F.col("_nth") <= n).drop("_in_tier", "_nth")


# ---- samples ----


def sample_per_group(frame: DataFrame, keys: list[str], k: int, id_col: str, seed: int = 42) -> DataFrame:
    """k random rows of each group."""
    return top_per(frame, keys, k, hash_order(seed, F.col(id_col)), F.col(id_col))


def sample_for_vocabulary(train: DataFrame, raw: DataFrame, component: str, id_col: str, record_col: str, max_entities: int = 50, max_records: int = 5, seed: int = 42) -> DataFrame:
    """Up to max_records of each of up to max_entities entities of a component."""
    ids = sample_per_group(train.select(component, id_col).distinct(), [component], max_entities, id_col, seed)
    return sample_per_group(raw.join(ids, id_col), [component, id_col], max_records, record_col, seed)


def quota_column(available: dict[str, Column], weights: dict[str, float], k: int, rounds: int | None = None) -> Column:
    """Quotas of each tier as a map: largest remainders by weight among tiers that are not full,
    capped by what is available, the rest dealt again until it is used up.

    A pure expression of the counts of a group. At least one tier fills up in each round but
    the last, so as many rounds as tiers are enough.
    """
    tiers = [t for t in sorted(weights) if weights[t] > 0]
    state = F.array(*[F.lit(0).cast("long") for _ in tiers])
    caps = F.array(*[available[t].cast("long") for t in tiers])
    w = F.array(*[F.lit(float(weights[t])) for t in tiers])
    index = F.sequence(F.lit(0), F.lit(len(tiers) - 1))

    def deal(state: Column, _: Column) -> Column:
        left = F.lit(k).cast("long") - F.aggregate(state, F.lit(0).cast("long"), lambda a, x: a + x)
        live = F.transform(index, lambda i: F.get(state, i) < F.get(caps, i))
        total = F.aggregate(index, F.lit(0.0), lambda a, i: a + F.when(F.get(live, i), F.get(w, i)).otherwise(0.0))
        raw = F.transform(index, lambda i: F.when(F.get(live, i) & (total > 0), left * (F.get(w, i) / total)).otherwise(0.0))
        spare = left - F.aggregate(raw, F.lit(0).cast("long"), lambda a, x: a + F.floor(x))
        fraction = F.transform(index, lambda i: F.get(raw, i) - F.floor(F.get(raw, i)))

        def rank(i: Column) -> Column:
            # tiers that come before i: a larger fraction, or an equal one and a later name
            ahead = F.filter(index, lambda j: F.get(live, j) & ((F.get(fraction, j) > F.get(fraction, i)) | ((F.get(fraction, j) == F.get(fraction, i)) & (j > i))))
            return F.size(ahead)

        share = F.transform(index, lambda i: F.floor(F.get(raw, i)) + F.when(F.get(live, i) & (rank(i) < spare), 1).otherwise(0))
        return F.transform(index, lambda i: F.get(state, i) + F.when(left > 0, F.least(F.get(share, i), F.get(caps, i) - F.get(state, i))).otherwise(0))

    quotas = F.aggregate(F.sequence(F.lit(1), F.lit(rounds or len(tiers))), state, deal)
    return F.map_from_arrays(F.array(*map(F.lit, tiers)), quotas)


def quota_sample(pool: DataFrame, keys: list[str], id_col: str, tier_col: str, weights: dict[str, float], k: int, seed: int = 42) -> DataFrame:
    """keys, id, tier, undersampled: k entities of each group, dealt over tiers by weight.

    Groups of at most k entities are taken whole and marked. Entities without a weighted tier
    fill up what the tiers cannot give, in random order.
    """
    tiers = [t for t in sorted(weights) if weights[t] > 0]
    rows = pool.select(*keys, id_col, tier_col).distinct()
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(tier_col) == t).alias(f"_n_{i}") for i, t in enumerate(tiers)])
    if tiers:
        quotas = quota_column({t: F.col(f"_n_{i}") for i, t in enumerate(tiers)}, weights, k)
        counts = counts.select(*keys, "_n", quotas.alias("_quota"))
        counts = counts.withColumn("_given", F.aggregate(F.map_values("_quota"), F.lit(0).cast("long"), lambda a, x: a + x))
    else:
        counts = counts.select(*keys, "_n", F.lit(None).cast("map<string,bigint>").alias("_quota"), F.lit(0).cast("long").alias("_given"))
    weighted = F.coalesce(F.col(tier_col).isin(*tiers), F.lit(False)) if tiers else F.lit(False)
    group = F.when(weighted, F.col(tier_col)).otherwise(F.lit(""))
    w = Window.partitionBy(*keys, "_group").orderBy(hash_order(seed, F.col(id_col)), F.col(id_col))
    ranked = rows.withColumn("_group", group).withColumn("_nth", F.row_number().over(w)).join(counts, keys)
    limit = F.when(F.col("_group") == "", F.lit(k) - F.col("_given")).otherwise(F.coalesce(F.element_at("_quota", F.col("_group")), F.lit(0)))
    undersampled = F.col("_n") <= k
    return ranked.where(undersampled | (F.col("_nth") <= limit)).select(*keys, id_col, tier_col, undersampled.alias("undersampled"))


def filter_to_collision(members: DataFrame, edges: DataFrame) -> DataFrame:
    """comp_a, comp_b, side, id of members in a designator that the pair shares; a pair side with
    none keeps all its members.

    members: component, id, level, value (one row per designator of the entity).
    """
    sides = edges.select("comp_a", "comp_b", "level", "value", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("side"))
    sides = sides.withColumn("component", F.when(F.col("side") == "a", F.col("comp_a")).otherwise(F.col("comp_b")))
    inside = sides.join(members, ["component", "level", "value"]).select("comp_a", "comp_b", "side", "component", "id").distinct()
    pairs = sides.select("comp_a", "comp_b", "side", "component").distinct()
    missing = pairs.join(inside.select("comp_a", "comp_b", "side").distinct(), ["comp_a", "comp_b", "side"], "left_anti")
    return inside.unionByName(missing.join(members.select("component", "id").distinct(), "component").select(*inside.columns))


def collision_samples(members: DataFrame, edges: DataFrame, k: int = 20, seed: int = 42, tiers: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """comp_a, comp_b, side, id, undersampled: k members on either side of every pair, all pairs at once."""
    pool = filter_to_collision(members, edges)
    keys = ["comp_a", "comp_b", "side"]
    if tiers is not None and weights:
        return quota_sample(pool.join(tiers, "id", "left"), keys, "id", "tier", weights, k, seed).drop("tier")
    w = Window.partitionBy(*keys)
    sizes = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranked = pool.withColumn("_nth", F.row_number().over(w.orderBy(hash_order(seed, F.col("id")), F.col("id")))).where(F.col("_nth") <= k)
    return ranked.join(sizes, keys).select(*keys, "id", (F.col("_n") <= k).alias("undersampled"))


def weighted_sample(frame: DataFrame, keys: list[str], n: int, weight: Column, id_col: str, seed: int = 42) -> DataFrame:
    """n rows of each group without replacement, by weight: the smallest -ln(u) / weight."""
    u = F.greatest(hash_unit(seed, F.col(id_col)), F.lit(1e-12))
    return top_per(frame.where(weight > 0), keys, n, -F.log(u) / weight, F.col(id_col))


def custom_order(frame: DataFrame, order: str, id_col: str, position: DataFrame | None = None) -> DataFrame:
    """Forward, inverted, or by an explicit table (id, pos); unknown ids come last."""
    if order == "forward":
        return frame.orderBy(id_col)
    if order == "inverted":
        return frame.orderBy(F.col(id_col).desc())
    if position is None:
        raise ValueError("an explicit order needs positions")
    return frame.join(position, id_col, "left").orderBy(F.col("pos").asc_nulls_last(), id_col).drop("pos")
