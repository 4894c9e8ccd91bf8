"""Hierarchy dimensions, discriminators, collision indexes, conflicts and exclusion rules.

A hierarchy is a table of designators: branch, depth, level_idx, level, value. It is a
dimension of an organisation, not of the data, but nothing here needs it to be small: all
operators are equi-joins and map-side aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canon_designator, value_type


def sorted_set(column):
    return F.array_sort(F.collect_set(column))


def level_names(dims: DataFrame) -> DataFrame:
    return dims.select(F.lower("level").alias("level")).distinct()


def valid_designators(dims: DataFrame, by_branch: bool = False) -> DataFrame:
    """Canonical designators of each level (and branch)."""
    keys = (["branch"] if by_branch else []) + [F.lower("level").alias("level")]
    return dims.select(*keys, canon_designator(F.col("value")).alias("value")).where("value IS NOT NULL").distinct()


def level_discriminators(dims: DataFrame) -> DataFrame:
    """level, appears_in, unique_to."""
    found = dims.groupBy("level").agg(sorted_set("branch").alias("appears_in"))
    return found.withColumn("unique_to", F.when(F.size("appears_in") == 1, F.col("appears_in")[0]))


def designator_discriminators(dims: DataFrame) -> DataFrame:
    """value, type, unique_to_branch, valid_in (branch to levels), collision_levels."""
    per_branch = dims.groupBy("value", "branch").agg(sorted_set("level").alias("levels"))
    found = per_branch.groupBy("value").agg(
        F.array_sort(F.collect_list(F.struct("branch", "levels"))).alias("entries"),
    )
    pairs = F.flatten(
        F.transform("entries", lambda e: F.transform(e["levels"], lambda x: F.struct(e["branch"].alias("branch"), x.alias("level"))))
    )
    return found.select(
        "value",
        value_type(F.col("value")).alias("type"),
        F.when(F.size("entries") == 1, F.col("entries")[0]["branch"]).alias("unique_to_branch"),
        F.map_from_entries("entries").alias("valid_in"),
        pairs.alias("collision_levels"),
    )


def depth_discriminators(dims: DataFrame) -> DataFrame:
    """depth, branches, is_unique."""
    found = dims.groupBy("depth").agg(sorted_set("branch").alias("branches"))
    return found.withColumn("is_unique", F.size("branches") == 1)


def collision_index(dims: DataFrame) -> DataFrame:
    """level, value and the members ``branch.level`` that share it, two at least."""
    member = F.concat_ws(".", "branch", "level")
    return dims.groupBy("level", "value").agg(sorted_set(member).alias("members")).where(F.size("members") >= 2)


def component_designators(paths: DataFrame, levels: DataFrame) -> DataFrame:
    """component, level, value of component paths ``branch/v1/v2``; levels has branch, level_idx, level."""
    parts = paths.select("component", F.split("component", "/").alias("parts"))
    placed = parts.select("component", F.col("parts")[0].alias("branch"), F.posexplode(F.slice("parts", 2, 1000)).alias("level_idx", "value"))
    return placed.join(levels.select("branch", "level_idx", "level").distinct(), ["branch", "level_idx"]).select("component", "branch", "level", "value")


def component_collisions(designators: DataFrame) -> DataFrame:
    """level, value and the components that share it, two at least."""
    found = designators.groupBy("level", F.col("value").cast("string").alias("value")).agg(sorted_set("component").alias("members"))
    return found.where(F.size("members") >= 2)


def merge_indexes(*indexes: DataFrame) -> DataFrame:
    """Union of the members of each key over several indexes."""
    out = indexes[0].select("level", "value", F.explode("members").alias("member"))
    for other in indexes[1:]:
        out = out.unionByName(other.select("level", "value", F.explode("members").alias("member")))
    return out.groupBy("level", "value").agg(sorted_set("member").alias("members"))


def conflict_edges(designators: DataFrame, key: str = "component") -> DataFrame:
    """comp_a < comp_b and each (level, value) they share: an equi-join on the designator.

    The pairs of one designator are those of its holders, which are components of an
    organisation. Keys held by many are met once by distinct before the join.
    """
    base = designators.select(F.col(key).alias("comp"), "level", "value").distinct()
    a = base.select(F.col("comp").alias("comp_a"), "level", "value")
    b = base.select(F.col("comp").alias("comp_b"), "level", "value")
    return a.join(b, ["level", "value"]).where("comp_a < comp_b")


def collision_pairs(edges: DataFrame) -> DataFrame:
    return edges.select("comp_a", "comp_b").distinct()


def rivals(edges: DataFrame) -> DataFrame:
    """component and all components that share a designator with it."""
    both = edges.select(F.col("comp_a").alias("component"), F.col("comp_b").alias("rival")).unionByName(
        edges.select(F.col("comp_b").alias("component"), F.col("comp_a").alias("rival"))
    )
    return both.groupBy("component").agg(sorted_set("rival").alias("rivals"))


def pair_levels(edges: DataFrame) -> DataFrame:
    """comp_a, comp_b and the designators they share."""
    return edges.groupBy("comp_a", "comp_b").agg(F.array_sort(F.collect_set(F.struct("level", "value"))).alias("shared"))


RULE_COLUMNS = ("rule_type", "excludes_branch", "implies_branch", "token", "depth", "condition", "strength", "rule_order")


def exclusion_rules(dims: DataFrame, deeper_only: bool = True) -> DataFrame:
    """What excludes each branch: terms and designators unique to another one, and depths.

    ``deeper_only`` excludes by depths greater than the branch's own (else by all other depths).
    """
    # the branches of an organisation, as one constant of the plan: no join pairs them off
    known = sorted(tuple(r) for r in dims.select("branch", F.col("depth").cast("int")).distinct().collect())
    branches = F.array(*[F.struct(F.lit(b).alias("excludes_branch"), F.lit(d).cast("int").alias("own_depth")) for b, d in known])
    branches = branches.cast("array<struct<excludes_branch:string,own_depth:int>>")
    others = F.inline(F.filter(branches, lambda b: b["excludes_branch"] != F.col("implies_branch")))
    level = level_discriminators(dims).where("unique_to IS NOT NULL").select(F.col("level").alias("token"), F.col("unique_to").alias("implies_branch"))
    value = (
        designator_discriminators(dims)
        .where("unique_to_branch IS NOT NULL")
        .select(F.col("value").alias("token"), F.col("unique_to_branch").alias("implies_branch"))
    )
    depths = depth_discriminators(dims).select("depth")
    none = F.lit(None)
    terms = level.select("*", others).select(
        F.lit("term_presence").alias("rule_type"), "excludes_branch", "implies_branch", "token", none.cast("int").alias("depth"),
        F.format_string("contains term '%s'", "token").alias("condition"), F.lit("definitive").alias("strength"), F.lit(1).alias("rule_order"),
    )
    values = value.select("*", others).select(
        F.lit("designator_invalidity").alias("rule_type"), "excludes_branch", "implies_branch", "token", none.cast("int").alias("depth"),
        F.format_string("contains designator '%s' (only valid in %s)", "token", "implies_branch").alias("condition"),
        F.lit("definitive").alias("strength"), F.lit(2).alias("rule_order"),
    )
    outside = F.filter(branches, lambda b: F.col("depth") > b["own_depth"] if deeper_only else F.col("depth") != b["own_depth"])
    deep = depths.select("depth", F.inline(outside)).select(
        F.lit("depth_mismatch").alias("rule_type"), "excludes_branch", none.cast("string").alias("implies_branch"), none.cast("string").alias("token"),
        F.col("depth").cast("int").alias("depth"),
        F.format_string("path has %d levels (branch only has %d)", F.col("depth").cast("int"), F.col("own_depth").cast("int")).alias("condition"),
        F.lit("definitive").alias("strength"), F.lit(3).alias("rule_order"),
    )
    return terms.unionByName(values).unionByName(deep)


def invalid_designators(dims: DataFrame) -> DataFrame:
    """branch, level, and the level's designators that are not valid in the branch."""
    everywhere = dims.groupBy("level").agg(F.collect_set("value").alias("all_values"))
    own = dims.groupBy("branch", "level").agg(F.collect_set("value").alias("own_values"))
    joined = own.join(everywhere, "level")
    return joined.select("branch", "level", F.array_sort(F.array_except("all_values", "own_values")).alias("invalid"))


def unique_designators(dims: DataFrame, branch_a: str, branch_b: str) -> DataFrame:
    """level, and the designators valid in only one of two branches."""
    own = dims.groupBy("level").pivot("branch", [branch_a, branch_b]).agg(F.collect_set("value"))
    a, b = F.coalesce(F.col(f"`{branch_a}`"), F.array()), F.coalesce(F.col(f"`{branch_b}`"), F.array())
    return own.select("level", F.array_sort(F.array_except(a, b)).alias("only_a"), F.array_sort(F.array_except(b, a)).alias("only_b"))


def peer_exclusions(dims: DataFrame) -> DataFrame:
    """Rules from peers: their unique terms and all other depths, deduplicated."""
    return dedupe_rules(exclusion_rules(dims, deeper_only=False).where("rule_type <> 'designator_invalidity'"))


def dedupe_rules(rules: DataFrame) -> DataFrame:
    """One rule for each branch and signature (token, or depth); the first by order stays."""
    from ..functions.relational import first_per

    signed = rules.withColumn("signature", F.coalesce("token", F.col("depth").cast("string"), "condition"))
    return first_per(signed, ["excludes_branch", "rule_type", "signature"], F.col("rule_order"), F.col("condition")).drop("signature")


def branch_discriminators(rules: DataFrame, dims: DataFrame) -> DataFrame:
    """branch and the terms that mark it: from rules that imply it and from unique levels; first wins."""
    from ..functions.relational import first_per

    implied = rules.where("implies_branch IS NOT NULL AND rule_type = 'term_presence'").select(
        F.col("implies_branch").alias("branch"), F.col("token").alias("term"), F.lit(1).alias("origin")
    )
    unique = level_discriminators(dims).where("unique_to IS NOT NULL").select(F.col("unique_to").alias("branch"), F.col("level").alias("term"), F.lit(2).alias("origin"))
    return first_per(implied.unionByName(unique), ["branch", "term"], F.col("origin")).drop("origin")
