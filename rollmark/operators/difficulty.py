"""Difficulty of entities: inferred from extraction, and from ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canon_designator, pair_left, pair_right
from .hierarchy import level_names, valid_designators

CHARACTERIZED, SINGLE_LEVEL, MULTI_LEVEL = 1.0, 0.75, 0.25
HIGH, LOW, DENOMINATOR_CAP = 0.7, 0.4, 4
SEVERITIES = ("none", "low", "medium", "high", "cross_branch")
COMPLETE = 0.95


# ---- inferred difficulty ----


def entity_signals(canonical: DataFrame, dims: DataFrame, id_col: str = "soldier_id") -> DataFrame:
    """One row per signal: entity, kind (pair, value, term), level, value.

    Pairs whose left part is a level name are characterised; unit terms that are no level
    names count as values; every term is a term in lower case and also a value to exclude by.
    """
    pair_columns = [c for c in canonical.columns if c.endswith(":Pair")]
    value_columns = [c for c in canonical.columns if c.startswith("Unchar_")]
    term_columns = [c for c in ("Unit_Terms", "Org_Terms") if c in canonical.columns]
    entries = []
    for c in pair_columns:
        entries.append(F.transform(_list(c), lambda x: F.struct(F.lit("pair").alias("kind"), F.lower(F.trim(pair_left(x))).alias("level"), canon_designator(pair_right(x)).alias("value"))))
    for c in value_columns:
        entries.append(F.transform(_list(c), lambda x: F.struct(F.lit("value").alias("kind"), F.lit("").alias("level"), canon_designator(x).alias("value"))))
    for c in term_columns:
        entries.append(F.transform(_list(c), lambda x: F.struct(F.lit("term").alias("kind"), F.lower(x).alias("level"), canon_designator(x).alias("value"))))
    if "Unit_Terms" in canonical.columns:
        entries.append(F.transform(_list("Unit_Terms"), lambda x: F.struct(F.lit("unit").alias("kind"), F.lower(x).alias("level"), canon_designator(x).alias("value"))))
    found = canonical.select(F.col(id_col).alias("entity"), F.inline(F.concat(*entries))).where("value IS NOT NULL").distinct()
    names = level_names(dims).withColumn("named", F.lit(True))
    found = found.join(F.broadcast(names), "level", "left").withColumn("named", F.coalesce("named", F.lit(False)))
    keep = ((F.col("kind") == "pair") & F.col("named")) | ((F.col("kind") == "unit") & ~F.col("named")) | F.col("kind").isin("value", "term")
    return found.where(keep).select(
        "entity",
        F.when(F.col("kind") == "unit", "value").otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("kind").isin("pair", "term"), F.col("level")).otherwise("").alias("level"),
        "value",
    ).distinct()


def _list(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.array().cast("array<string>"))


def value_levels(signals: DataFrame, dims: DataFrame) -> DataFrame:
    """entity, value, and the levels where an uncharacterised value is valid (none included)."""
    values = signals.where("kind = 'value'").select("entity", "value").distinct()
    valid = valid_designators(dims).groupBy("value").agg(F.array_sort(F.collect_set("level")).alias("levels"))
    joined = values.join(F.broadcast(valid), "value", "left")
    return joined.select("entity", "value", F.coalesce("levels", F.array().cast("array<string>")).alias("levels"))


def collision_position(signals: DataFrame, levels: DataFrame, index: DataFrame, dims: DataFrame, entities: DataFrame) -> DataFrame:
    """entity, in_collision, candidates: branches of the colliding components, else all branches."""
    probes = signals.where("kind = 'pair'").select("entity", "level", "value").unionByName(levels.select("entity", F.explode("levels").alias("level"), "value"))
    members = index.select(F.lower("level").alias("level"), canon_designator(F.col("value")).alias("value"), F.explode("members").alias("member"))
    hits = probes.join(F.broadcast(members), ["level", "value"]).groupBy("entity").agg(F.array_sort(F.collect_set(F.substring_index("member", ".", 1))).alias("found"))
    names = sorted(r[0] for r in dims.select("branch").distinct().collect())  # the branches of the organisation
    everything = F.array(*map(F.lit, names)).cast("array<string>")
    return entities.join(hits, "entity", "left").select("entity", F.col("found").isNotNull().alias("in_collision"), F.coalesce("found", everything).alias("candidates"))


def inferred_difficulty(canonical: DataFrame, dims: DataFrame, index: DataFrame, rules: DataFrame, id_col: str = "soldier_id") -> DataFrame:
    """One row per entity: collision, candidates, constraints, confidences, score and tier.

    dims, index and rules describe an organisation and are broadcast; entities are not
    collected anywhere.
    """
    entities = canonical.select(F.col(id_col).alias("entity")).distinct()
    signals = entity_signals(canonical, dims, id_col)
    levels = value_levels(signals, dims)
    position = collision_position(signals, levels, index, dims, entities)

    pairs = signals.where("kind = 'pair'").select("entity", "level", "value").distinct()
    grouped_pairs = pairs.groupBy("entity").agg(F.collect_set(F.struct("level", "value")).alias("pairs"))
    grouped_values = levels.groupBy("entity").agg(F.collect_list(F.struct("value", "levels")).alias("values"))
    grouped_terms = signals.where("kind = 'term'").groupBy("entity").agg(F.collect_set("level").alias("terms"), F.collect_set("value").alias("term_values"))
    no = F.array()
    base = position.join(grouped_pairs, "entity", "left").join(grouped_values, "entity", "left").join(grouped_terms, "entity", "left").select(
        "entity",
        "in_collision",
        "candidates",
        F.coalesce("pairs", no.cast("array<struct<level:string,value:string>>")).alias("pairs"),
        F.coalesce("values", no.cast("array<struct<value:string,levels:array<string>>>")).alias("values"),
        F.coalesce("terms", no.cast("array<string>")).alias("terms"),
        F.array_union(
            F.transform(F.coalesce("values", no.cast("array<struct<value:string,levels:array<string>>>")), lambda v: v["value"]),
            F.coalesce("term_values", no.cast("array<string>")),
        ).alias("excluders"),
    )
    levels_seen = F.size(F.array_distinct(F.transform("pairs", lambda p: p["level"])))
    base = base.withColumn("extracted", F.nullif(levels_seen + F.size(F.filter("values", lambda v: F.size(v["levels"]) == 1)), F.lit(0)))
    has_any = (F.size("pairs") > 0) | F.exists("values", lambda v: F.size(v["levels"]) > 0) | (F.size("terms") > 0)
    base = base.withColumn("has_any", has_any).withColumn("in_collision", F.col("in_collision") | ~F.col("has_any"))

    # one row per entity and candidate branch
    branches = dims.groupBy(F.col("branch").alias("candidate")).agg(
        F.first("depth").cast("int").alias("branch_depth"),
        F.array_distinct(F.collect_list(F.lower("level"))).alias("branch_levels"),
        F.collect_set(F.struct(F.lower("level").alias("level"), canon_designator(F.col("value")).alias("value"))).alias("valid"),
    )
    ruled = rules.groupBy(F.col("excludes_branch").alias("candidate")).agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("rule_order"), F.col("condition"), F.col("rule_type"), F.col("token"), F.col("depth")))
        ).alias("rules")
    )
    rule_type = "array<struct<rule_order:int,condition:string,rule_type:string,token:string,depth:int>>"
    side = branches.join(ruled, "candidate", "left").withColumn("rules", F.coalesce("rules", F.array().cast(rule_type)))
    wide = base.withColumn("candidate", F.explode("candidates")).join(F.broadcast(side), "candidate")
    too_deep = F.col("extracted") > F.col("branch_depth")
    hit = F.filter(
        "rules",
        lambda r: F.when(r["rule_type"] == "term_presence", F.array_contains(F.col("terms"), F.lower(r["token"])))
        .when(r["rule_type"] == "designator_invalidity", F.array_contains(F.col("excluders"), canon_designator(r["token"])))
        .otherwise(F.coalesce(r["depth"] == F.col("extracted"), F.lit(False))),
    )
    depth_text = F.format_string("depth %d exceeds branch depth %d for %s", F.col("extracted").cast("int"), "branch_depth", "candidate")
    wide = wide.withColumn("constraint", F.when(too_deep, depth_text).otherwise(F.get(hit, F.lit(0))["condition"]))
    confident = _confidences()
    contradicted = F.exists("pairs", lambda p: ~F.array_contains(F.col("valid"), p))
    denominator = F.least(F.col("branch_depth"), F.lit(DENOMINATOR_CAP))
    total = F.aggregate(F.map_values(confident), F.lit(0.0), lambda a, x: a + x)
    wide = wide.withColumns(
        {
            "confidences": confident,
            "score": F.when(contradicted | (denominator <= 0), 0.0).otherwise(total / denominator),
            "remains": F.col("constraint").isNull(),
        }
    )
    best = F.struct(F.col("score"), F.col("candidate"), F.col("confidences"))
    per_entity = wide.groupBy("entity").agg(
        F.first("in_collision").alias("in_collision"),
        F.first("has_any").alias("has_any"),
        F.array_sort(F.collect_list(F.when(F.col("remains"), F.col("candidate")))).alias("remaining"),
        F.array_sort(F.collect_list("constraint")).alias("constraints"),
        # the highest score; of equal ones the first branch
        F.min_by(best, F.struct(F.when(F.col("remains"), 0).otherwise(1), -F.col("score"), F.col("candidate"))).alias("best"),
    )
    resolvable = F.size("remaining") == 1
    score = F.when(F.size("remaining") > 0, F.col("best")["score"]).otherwise(0.0)
    tier = tier_of("in_collision", "inferred_structural_resolvability", "inferred_complementarity_score")
    out = per_entity.select(
        F.col("entity").alias(id_col),
        F.col("in_collision").alias("inferred_collision_position"),
        score.alias("inferred_complementarity_score"),
        resolvable.alias("inferred_structural_resolvability"),
        F.col("remaining").alias("inferred_candidate_branches"),
        F.when(score > 0, F.col("best")["confidences"]).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))).alias("inferred_level_confidences"),
        F.when(resolvable, F.col("constraints")).otherwise(F.array().cast("array<string>")).alias("inferred_eliminating_constraints"),
        "has_any",
        "in_collision",
    )
    return out.withColumn("inferred_difficulty_tier", F.when(~F.col("has_any"), "extreme").otherwise(tier)).drop("has_any", "in_collision")


def _confidences() -> Column:
    """The confidence of each level of the candidate branch."""

    def of_level(level: Column) -> Column:
        characterised = F.exists("pairs", lambda p: p["level"] == level)

        def here(v: Column) -> Column:
            return F.filter(v["levels"], lambda x: F.array_contains(F.col("valid"), F.struct(x.alias("level"), v["value"].alias("value"))))

        single = F.exists("values", lambda v: (F.size(here(v)) == 1) & F.array_contains(here(v), level))
        multi = F.exists("values", lambda v: (F.size(here(v)) > 1) & F.array_contains(here(v), level))
        return F.when(characterised, CHARACTERIZED).when(single, SINGLE_LEVEL).when(multi, MULTI_LEVEL).otherwise(0.0)

    return F.map_from_arrays("branch_levels", F.transform("branch_levels", of_level))


def tier_of(collision: str, resolvable: str, score: str) -> Column:
    return (
        F.when(~F.col(collision), "easy")
        .when(F.col(resolvable), "moderate")
        .when(F.col(score) >= HIGH, "moderate")
        .when(F.col(score) >= LOW, "hard")
        .otherwise("extreme")
    )


# ---- ground truth difficulty ----


def severity(states: DataFrame, index: DataFrame) -> DataFrame:
    """Collision severity of each state.

    states: soldier_id, state_id, branch, post_levels (map). index: section, designator, branch,
    level; sections are searched numbers, letters, names, and the first that has the designator counts.
    """
    order = F.when(F.col("section") == "numbers", 1).when(F.col("section") == "letters", 2).otherwise(3)
    entries = index.groupBy("designator", order.alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.collect_set("branch").alias("branches"))
    entries = entries.groupBy("designator").agg(F.min_by(F.struct("n", "branches"), "priority").alias("hit"))
    exploded = states.select("soldier_id", "state_id", "branch", F.explode_outer(F.map_values("post_levels")).alias("designator"))
    probed = exploded.join(F.broadcast(entries), "designator", "left").groupBy("soldier_id", "state_id", "branch").agg(
        F.coalesce(F.max(F.col("hit")["n"]), F.lit(0)).alias("most"),
        F.coalesce(F.bool_or(F.exists(F.col("hit")["branches"], lambda b: b != F.col("branch"))), F.lit(False)).alias("cross"),
    )
    word = F.when(F.col("cross"), "cross_branch").when(F.col("most") <= 1, "none").when(F.col("most") == 2, "low").when(F.col("most") == 3, "medium").otherwise("high")
    return probed.select("soldier_id", "state_id", "branch", word.alias("gt_collision_severity")).withColumn("gt_collision_zone_flag", F.col("gt_collision_severity") != "none")


def severity_order(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), name)


def colliding_paths(states: DataFrame, index: DataFrame) -> DataFrame:
    """soldier_id, state_id, sorted ``branch.level:designator`` of other branches."""
    probes = states.select("soldier_id", "state_id", F.col("branch").alias("own"), F.explode(F.map_values("post_levels")).alias("designator"))
    path = F.concat(F.col("branch"), F.lit("."), F.col("level"), F.lit(":"), F.col("designator"))
    hits = probes.join(F.broadcast(index), "designator").where("branch <> own")
    return hits.groupBy("soldier_id", "state_id").agg(F.array_sort(F.collect_set(path)).alias("paths"))


def gt_complementarity(records: DataFrame, states: DataFrame, depths: DataFrame) -> DataFrame:
    """soldier_id, score: mean coverage / (1 + mean redundancy) over the soldier's states.

    records: soldier_id, state_id, levels_provided. depths: branch, depth. Levels are counted
    in three aggregates (level, state, soldier); a state without records counts as zero.
    """
    counted = records.select("soldier_id", "state_id", F.explode("levels_provided").alias("level")).groupBy("soldier_id", "state_id", "level").agg(F.count(F.lit(1)).alias("n"))
    per_state = counted.groupBy("soldier_id", "state_id").agg(F.count(F.lit(1)).alias("levels"), F.avg("n").alias("mean"))
    joined = states.select("soldier_id", "state_id", "branch").join(F.broadcast(depths), "branch", "left").join(per_state, ["soldier_id", "state_id"], "left")
    coverage = F.coalesce(F.col("levels") / F.greatest(F.coalesce("depth", F.lit(1)), F.lit(1)), F.lit(0.0))
    redundancy = F.coalesce(F.greatest(F.lit(0.0), F.col("mean") - 1) / F.col("mean"), F.lit(0.0))
    per_soldier = joined.groupBy("soldier_id").agg(F.avg(coverage).alias("coverage"), F.avg(redundancy).alias("redundancy"))
    return per_soldier.select("soldier_id", (F.col("coverage") / (1 + F.col("redundancy"))).alias("gt_complementarity_score"))


def gt_resolvability(records: DataFrame, states: DataFrame, unique_terms: DataFrame) -> DataFrame:
    """soldier_id, resolvable: a structural signal, or a term unique to one of the soldier's
    branches in one of its texts. unique_terms: branch, term (a vocabulary, broadcast as one array
    for each branch; texts are searched in place, not joined by containment)."""
    signal = F.exists(F.coalesce("extraction_signals", F.array().cast("array<string>")), lambda s: s.startswith("branch_unique:") | (s == "depth:5"))
    terms = unique_terms.groupBy("branch").agg(F.collect_set(F.lower("term")).alias("terms"))
    own = states.select("soldier_id", "branch").distinct().join(F.broadcast(terms), "branch").groupBy("soldier_id").agg(F.flatten(F.collect_list("terms")).alias("terms"))
    joined = records.select("soldier_id", signal.alias("signal"), F.lower("raw_text").alias("text")).join(own, "soldier_id", "left")
    hit = F.col("signal") | F.coalesce(F.exists("terms", lambda t: F.contains(F.col("text"), t)), F.lit(False))
    return joined.groupBy("soldier_id").agg(F.bool_or(hit).alias("gt_structural_resolvability"))


def gt_tier(complete: Column, zone: Column, worst: Column, score: Column, resolvable: Column) -> Column:
    """Ten ordered rules."""
    return (
        F.when(complete & ~zone, "easy")
        .when(complete & zone & resolvable, "easy")
        .when((score > 0.8) & ~zone, "easy")
        .when(resolvable & (score > 0.5), "easy")
        .when(complete & zone, "moderate")
        .when(~zone & (score > 0.5), "moderate")
        .when(zone & (score > 0.6), "moderate")
        .when(resolvable, "moderate")
        .when((worst == "cross_branch") & (score < 0.3), "extreme")
        .when(zone & (score < 0.3), "extreme")
        .otherwise("hard")
    )


def merge_metadata(raw: DataFrame, meta: DataFrame) -> DataFrame:
    """raw left-joined with record metadata on the keys they share; clashing names get ``_synthetic``."""
    keys = [k for k in ("source_id", "soldier_id") if k in raw.columns and k in meta.columns]
    if not keys:
        return raw
    renamed = meta.select(*[F.col(c) if c in keys or c not in raw.columns else F.col(c).alias(f"{c}_synthetic") for c in meta.columns])
    return raw.join(renamed, keys, "left")


def gt_difficulty(states: DataFrame, records: DataFrame, depths: DataFrame, index: DataFrame, unique_terms: DataFrame) -> DataFrame:
    """One row per state with its soldier's score, resolvability and tier."""
    per_state = severity(states, index)
    worst = per_state.groupBy("soldier_id").agg(
        F.bool_or("gt_collision_zone_flag").alias("zone"), F.max_by("gt_collision_severity", severity_order(F.col("gt_collision_severity"))).alias("worst")
    )
    complete = records.groupBy("soldier_id").agg(F.coalesce(F.bool_or(F.col("path_completeness") >= COMPLETE), F.lit(False)).alias("complete"))
    scored = (
        worst.join(complete, "soldier_id", "left")
        .join(gt_complementarity(records, states, depths), "soldier_id", "left")
        .join(gt_resolvability(records, states, unique_terms), "soldier_id", "left")
        .withColumns(
            {
                "complete": F.coalesce("complete", F.lit(False)),
                "gt_structural_resolvability": F.coalesce("gt_structural_resolvability", F.lit(False)),
                "gt_complementarity_score": F.coalesce("gt_complementarity_score", F.lit(0.0)),
            }
        )
    )
    tier = gt_tier(F.col("complete"), F.col("zone"), F.col("worst"), F.col("gt_complementarity_score"), F.col("gt_structural_resolvability"))
    scored = scored.select("soldier_id", "gt_complementarity_score", "gt_structural_resolvability", tier.alias("gt_difficulty_tier"))
    return per_state.join(scored, "soldier_id", "left")
