"""Synthetic rosters: entities with states, sources, rendered records with imperfections.

Every random choice is a hash of (seed, key, purpose), so rows are independent of each other and
of partitioning: any part of a data set can be made anywhere, again and again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.relational import let
from ..functions.text import hash_unit, home_unit_key, post_path

#: Shares of choices (fixed values).
STATE_COUNTS = ((1, 0.65), (2, 0.28), (3, 0.07))
TRANSFERS = (("within_level3", 0.20), ("within_level2", 0.30), ("within_level1", 0.35), ("cross_branch", 0.15))
QUALITY_TIERS = ((1, 0.20), (2, 0.35), (3, 0.25), (4, 0.15), (5, 0.05))
SAME_BRANCH_SHARE = 0.7
RECENT_SHARE = 0.7
LAYERS = (("situational", {"low": 0.15, "medium": 0.35, "high": 0.55}), ("confounder", {"any": 0.15}))
FIRST_NAMES = ("Ada", "Bruno", "Clara", "David", "Elena", "Felix", "Greta", "Hugo", "Ines", "Jonas")
LAST_NAMES = ("Abbot", "Berger", "Cole", "Duval", "Engel", "Frost", "Garcia", "Holm", "Ivers", "Jensen")
RANKS = (("Recruit", 0.4), ("Guard", 0.3), ("Chief", 0.2), ("Marshal", 0.1))
PHONETIC = {"A": "Alfa", "B": "Bravo", "C": "Charlie", "D": "Delta", "E": "Echo", "F": "Foxtrot"}
OCR = (("l", "1"), ("O", "0"), ("rn", "m"), ("m", "rn"), ("S", "5"), ("E", "F"))
IMPERFECTIONS = {"trailing_off": 0.05, "typo": 0.1, "correction": 0.05, "incomplete": 0.05, "bleed": 0.05}


def u(seed: int, purpose: str, *keys: Column) -> Column:
    return hash_unit(seed, F.lit(purpose), *keys)


def pick_weighted(draw: Column, options) -> Column:
    """The option whose cumulative weight reaches the draw."""
    out, at = None, 0.0
    for value, weight in options:
        at += weight
        out = F.when(draw < at, F.lit(value)) if out is None else out.when(draw < at, F.lit(value))
    return out.otherwise(F.lit(options[-1][0]))


def pick(draw: Column, options: Column) -> Column:
    """One element of an array, each as likely."""
    return let(options, lambda x: F.element_at(x, F.least(F.floor(draw * F.size(x)).cast("int") + 1, F.size(x))))


def branch_table(dims: DataFrame) -> DataFrame:
    """branch, levels in order, and a map from level to its values: the organisation, broadcast."""
    per_level = dims.groupBy("branch", "level_idx", "level").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return per_level.groupBy("branch").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("level_idx", "level"))), lambda x: x["level"]).alias("levels"),
        F.map_from_entries(F.collect_list(F.struct("level", "values"))).alias("level_values"),
    )


def soldiers(spark: SparkSession, n: int, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """soldier_id, name, rank, n_states."""
    key = F.col("id")
    base = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return base.select(
        F.format_string("S%06d", "id").alias("soldier_id"),
        F.concat_ws(" ", pick(u(seed, "first", key), F.array(*map(F.lit, FIRST_NAMES))), pick(u(seed, "last", key), F.array(*map(F.lit, LAST_NAMES)))).alias("name"),
        pick_weighted(u(seed, "rank", key), RANKS).alias("rank"),
        pick_weighted(u(seed, "states", key), STATE_COUNTS).alias("n_states"),
    )


def _post(seed: int, purpose: str, key: Column, order: Column, levels: Column, values: Column) -> Column:
    draw = lambda x: hash_unit(seed, F.lit(purpose), key, order, x)
    return F.map_from_arrays(levels, F.transform(levels, lambda x: pick(draw(x), F.element_at(values, x))))


def states(people: DataFrame, dims: DataFrame, seed: int = 42) -> DataFrame:
    """One row per entity and state: branch, post_levels, post_path and the transfer that led there.

    The first post is uniform. A transfer keeps the upper three, two or one levels and draws the
    others anew, other than before where there is a choice, or goes to another branch.
    """
    table = branch_table(dims)
    names = sorted(r[0] for r in table.select("branch").collect())  # the branches of the organisation
    branches = F.array(*map(F.lit, names))
    key = F.col("soldier_id")
    info = F.broadcast(table)
    first = people.withColumn("branch", pick(u(seed, "branch", key), branches)).join(info, "branch")
    first = first.withColumn("post_levels", _post(seed, "post", key, F.lit(0), F.col("levels"), F.col("level_values")))
    rows = first.select("soldier_id", "name", "rank", "n_states", F.lit(1).alias("state_order"), F.lit(None).cast("string").alias("transfer"), "branch", "levels", "post_levels")
    last, out = rows, rows
    for order in (2, 3):
        scope = pick_weighted(hash_unit(seed, F.lit("scope"), key, F.lit(order)), TRANSFERS)
        moved = last.where(F.col("n_states") >= order).withColumn("transfer", scope)
        others = F.array_remove(branches, F.col("branch"))
        cross = (F.col("transfer") == "cross_branch") & (F.size(others) > 0)
        moved = moved.withColumn("new_branch", F.when(cross, pick(hash_unit(seed, F.lit("cross"), key, F.lit(order)), others)).otherwise(F.col("branch")))
        moved = moved.drop("levels").withColumnRenamed("branch", "old_branch").join(info, F.col("new_branch") == F.col("branch"))
        depth = F.size("levels")
        keep = (
            F.when(F.col("old_branch") != F.col("new_branch"), 0)
            .when((F.col("transfer") == "within_level3") & (depth > 3), 3)
            .when(F.col("transfer").isin("within_level3", "within_level2"), 2)
            .otherwise(1)
        )
        moved = moved.withColumns({"keep": keep, "next_order": F.lit(order)})

        def value(x: Column, i: Column) -> Column:
            options = F.element_at("level_values", x)
            before = F.element_at("post_levels", x)
            other = F.array_remove(options, F.coalesce(before, F.lit("")))
            return F.when(i < F.col("keep"), before).otherwise(pick(hash_unit(seed, F.lit("move"), key, F.col("next_order"), x), F.when(F.size(other) > 0, other).otherwise(options)))

        moved = moved.withColumn("post_levels", F.map_from_arrays("levels", F.transform("levels", value)))
        last = moved.select("soldier_id", "name", "rank", "n_states", F.lit(order).alias("state_order"), "transfer", "branch", "levels", "post_levels")
        out = out.unionByName(last)
    return out.select(
        "soldier_id", "name", "rank", "n_states", "state_order", F.concat_ws("-", "soldier_id", F.col("state_order").cast("string")).alias("state_id"),
        "transfer", "branch", "levels", "post_levels", post_path(F.col("levels"), F.col("post_levels")).alias("post_path"),
    )


def sources(spark: SparkSession, n: int, homes: DataFrame, seed: int = 42) -> DataFrame:
    """source_id, quality_tier, home_unit, temporal_anchor, n_entries (35 on average, 8 to 80).

    homes: branch, levels, post_levels of possible home posts, taken in turn.
    """
    numbered = homes.select("branch", "levels", "post_levels").withColumn("home", F.row_number().over(Window.orderBy("branch", F.to_json("post_levels"))) - 1)
    total = max(1, numbered.count())
    key = F.col("id")
    normal = F.sqrt(-2 * F.log(F.greatest(u(seed, "n1", key), F.lit(1e-9)))) * F.cos(2 * F.pi() * u(seed, "n2", key))
    base = spark.range(n).withColumn("home", F.floor(u(seed, "home", key) * total).cast("int"))
    path = F.transform("levels", lambda x: F.element_at("post_levels", x))
    return base.join(F.broadcast(numbered), "home").select(
        F.format_string("D%06d", "id").alias("source_id"),
        pick_weighted(u(seed, "tier", key), QUALITY_TIERS).alias("quality_tier"),
        home_unit_key(F.col("branch"), path).alias("home_unit"),
        F.col("branch").alias("home_branch"),
        pick_weighted(u(seed, "anchor", key), ((1, 0.5), (2, 0.3), (3, 0.2))).alias("temporal_anchor"),
        F.least(F.lit(80), F.greatest(F.lit(8), (35 + 15 * normal).cast("int"))).alias("n_entries"),
    )


def entries(source: DataFrame, state: DataFrame, seed: int = 42) -> DataFrame:
    """source_id, entry, soldier_id and the state a source sees: n_entries entities of each source, drawn
    by hash, mostly (70 %) of the home branch; the state is the anchor's or the last one."""
    ranked = state.where("state_order = 1").select("branch", "soldier_id")
    sizes = ranked.groupBy("branch").agg(F.count(F.lit(1)).alias("size"))
    ranked = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("branch").orderBy("soldier_id")))
    names = sorted(r[0] for r in sizes.select("branch").collect())
    slots = source.select("source_id", "home_branch", "temporal_anchor", "quality_tier", "home_unit", F.explode(F.sequence(F.lit(1), F.col("n_entries"))).alias("entry"))
    same = u(seed, "same", F.col("source_id"), F.col("entry")) < SAME_BRANCH_SHARE
    slots = slots.withColumn("branch", F.when(same, F.col("home_branch")).otherwise(pick(u(seed, "other", F.col("source_id"), F.col("entry")), F.array(*map(F.lit, names)))))
    slots = slots.join(F.broadcast(sizes), "branch")
    slots = slots.withColumn("nth", F.floor(u(seed, "who", F.col("source_id"), F.col("entry")) * F.col("size")).cast("int") + 1)
    chosen = slots.join(ranked, ["branch", "nth"]).dropDuplicates(["source_id", "soldier_id"])
    counts = state.groupBy("soldier_id").agg(F.max("state_order").alias("last"))
    chosen = chosen.join(counts, "soldier_id").withColumn("state_order", F.least("temporal_anchor", "last")).drop("branch", "nth", "size", "last")
    return chosen.join(state, ["soldier_id", "state_order"])


#: Chances of a clerk's archetype (fixed values): to leave levels out, to mistype, to abbreviate.
ARCHETYPES = {"careful": (0.05, 0.02, 0.2), "hurried": (0.4, 0.2, 0.6), "tired": (0.3, 0.3, 0.4), "terse": (0.5, 0.05, 0.9)}


def clerks(spark: SparkSession, n: int, seed: int = 42, jitter: float = 0.1) -> DataFrame:
    """clerk_id, archetype, and its chances with uniform jitter, kept between 0 and 1."""
    key = F.col("id")
    kind = pick(u(seed, "archetype", key), F.array(*map(F.lit, sorted(ARCHETYPES))))
    base = spark.range(n).withColumn("archetype", kind)
    out = [F.format_string("K%04d", "id").alias("clerk_id"), "archetype"]
    for i, name in enumerate(("omits", "mistypes", "abbreviates")):
        value = F.element_at(F.create_map(*[F.lit(x) for k, v in sorted(ARCHETYPES.items()) for x in (k, v[i])]), F.col("archetype"))
        out.append(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value + (2 * u(seed, name, key) - 1) * jitter)).alias(name))
    return base.select(*out)


def resolve_terms(vocabulary: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern and its terms: ``defense_*`` stands for all lists whose name starts with ``defense_``.
    vocabulary: name, terms (array). patterns: pattern. Both are small dimensions."""
    wild = F.col("pattern").endswith("*")
    prefix = F.expr("substring(pattern, 1, length(pattern) - 1)")
    match = F.when(wild, F.startswith(F.col("name"), prefix)).otherwise(F.col("name") == F.col("pattern"))
    joined = F.broadcast(patterns.distinct()).join(vocabulary, match, "left")
    return joined.groupBy("pattern").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("terms", F.array().cast("array<string>")))))).alias("terms"))


def inject_terms(text: Column, terms: Column, chance: float, seed: int, purpose: str, *keys: Column) -> Column:
    """Add one of the terms to a text by chance, after one or (30 %) two spaces."""
    hit = (hash_unit(seed, F.lit(purpose), *keys) < chance) & (F.size(terms) > 0)
    gap = F.when(hash_unit(seed, F.lit(purpose + "_gap"), *keys) < 0.3, "  ").otherwise(" ")
    return F.when(hit, F.concat(text, gap, pick(hash_unit(seed, F.lit(purpose + "_term"), *keys), terms))).otherwise(text)


def roster_stats(source: DataFrame, record: DataFrame) -> DataFrame:
    """One row: entities, sources, records, records per source, share of complete records, mean quality tier."""
    per = record.agg(
        F.count_distinct("soldier_id").alias("n_soldiers"), F.count(F.lit(1)).alias("n_records"),
        F.avg((F.col("path_completeness") >= 0.95).cast("int")).alias("complete_share"), F.avg("quality_tier").alias("mean_tier"),
    )
    sources_n = source.agg(F.count(F.lit(1)).alias("n_sources"))
    return per.join(F.broadcast(sources_n)).withColumn("records_per_source", F.col("n_records") / F.greatest(F.col("n_sources"), F.lit(1)))


def familiarity(home_branch: Column, home_levels: Column, branch: Column, levels: Column, post: Column) -> Column:
    """same_l3, same_l2, same_branch or different_branch, from the first three levels."""
    at = lambda i: F.element_at(post, F.get(levels, F.lit(i))) == F.get(home_levels, F.lit(i))
    return (
        F.when(home_branch != branch, "different_branch")
        .when(F.size(levels) < 3, "same_branch")
        .when(at(0) & at(1) & at(2), "same_l3")
        .when(at(0) & at(1), "same_l2")
        .otherwise("same_branch")
    )


def kept_levels(levels: Column, familiar: Column, tier: Column, seed: int, *keys: Column) -> Column:
    """Levels that an entry gives: the lower ones to the familiar; poor sources drop more of them, the
    upper ones first (weights fall with the square of the depth); never none."""
    base = (
        F.when(familiar == "same_l3", F.slice(levels, F.size(levels), 1))
        .when(familiar == "same_l2", F.slice(levels, 3, F.size(levels)))
        .when(familiar == "same_branch", F.slice(levels, 2, F.size(levels)))
        .otherwise(levels)
    )
    chance = F.element_at(F.array(F.lit(1.0), F.lit(0.95), F.lit(0.85), F.lit(0.7), F.lit(0.5)), tier)
    kept = F.filter(base, lambda x, i: hash_unit(seed, F.lit("keep"), *keys, x) < chance + (1 - chance) * F.pow(i / F.greatest(F.size(base), F.lit(1)), F.lit(2)))
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(levels, F.size(levels), 1))


def unit_text(levels: Column, post: Column, style: Column) -> Column:
    """Posts as labelled, slashed, run on or minimal text; single letters spelt out when labelled."""
    phonetic = F.create_map(*[F.lit(x) for pair in PHONETIC.items() for x in pair])
    value = lambda x: F.element_at(post, x)
    labelled = F.array_join(F.transform(levels, lambda x: F.concat_ws(" ", F.initcap(x), F.coalesce(F.element_at(phonetic, value(x)), value(x)))), ", ")
    short = F.array_join(F.transform(levels, lambda x: F.concat(F.upper(F.substring(x, 1, 3)), F.lit(" "), value(x))), " ")
    plain = F.transform(levels, value)
    return F.when(style == 0, labelled).when(style == 1, F.array_join(plain, "/")).when(style == 2, short).when(style == 3, F.array_join(plain, "")).otherwise(F.array_join(plain, "-"))


def imperfect(text: Column, tier: Column, seed: int, *keys: Column) -> Column:
    """Cut off, mistyped, corrected, shortened or run together, each by chance; good sources less."""
    scale = F.lit(0.4) + 0.4 * (tier - 1)
    hit = lambda name: hash_unit(seed, F.lit(name), *keys) < F.lit(IMPERFECTIONS[name]) * scale
    draw = lambda name: hash_unit(seed, F.lit(name), *keys)
    size = F.char_length

    def cut(x: Column) -> Column:
        left = F.greatest(F.lit(2), (size(x) * (0.5 + 0.5 * draw("cut"))).cast("int"))
        return F.when(hit("trailing_off") & (size(x) > 4), F.substring(x, F.lit(1), left)).otherwise(x)

    def typo_at(x: Column, at: Column) -> Column:
        head, rest = F.substring(x, F.lit(1), at - 1), lambda k: F.substring(x, at + k, size(x))
        omit = F.concat(head, rest(1))
        double = F.concat(head, F.substring(x, at, F.lit(1)), rest(0))
        swap = F.concat(head, F.substring(x, at + 1, F.lit(1)), F.substring(x, at, F.lit(1)), rest(2))
        return F.when(draw("typo_kind") < 0.25, omit).when(draw("typo_kind") < 0.5, double).when(draw("typo_kind") < 0.75, swap).otherwise(misread(x))

    def misread(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for a, b in OCR:
            place = F.instr(x, a)
            out = F.coalesce(out, F.when(place > 0, F.concat(F.substring(x, F.lit(1), place - 1), F.lit(b), F.substring(x, place + len(a), size(x)))))
        return F.coalesce(out, x)

    def typed(x: Column) -> Column:
        at = F.floor(draw("typo_at") * size(x)).cast("int") + 1
        return F.when(hit("typo") & (size(x) > 2), let(at, lambda a: typo_at(x, a))).otherwise(x)

    def corrected(x: Column) -> Column:
        def fix(digit: Column) -> Column:
            after = F.pmod(digit.cast("int") + 1, F.lit(10)).cast("string")
            return F.when(hit("correction") & (digit != ""), F.regexp_replace(x, F.concat(F.lit("^([^0-9]*)"), digit), F.concat(F.lit("$1"), digit, F.lit(" "), after))).otherwise(x)

        return let(F.regexp_extract(x, "([0-9])", 1), fix)

    shorter = lambda x: F.when(hit("incomplete"), F.regexp_replace(x, r"^([^,/]+)[,/] ?", "")).otherwise(x)
    bled = lambda x: F.when(hit("bleed"), F.regexp_replace(x, r"^(.*?\w) (?=\w)", "$1")).otherwise(x)
    out = text
    for step in (cut, typed, corrected, shorter, bled):
        out = let(out, step)
    return out


def records(entry: DataFrame, unique_terms: DataFrame, seed: int = 42) -> DataFrame:
    """source_id, soldier_id, state_id, raw_text, quality_tier, path_completeness, levels_provided,
    extraction_signals of each entry. unique_terms: branch, term."""
    key = (F.col("source_id"), F.col("soldier_id"))
    home = F.split(F.substring_index("home_unit", ":", -1), "/")
    terms = unique_terms.groupBy("branch").agg(F.array_sort(F.collect_set(F.lower("term"))).alias("own_terms"))
    base = entry.join(F.broadcast(terms), "branch", "left").withColumn("familiar", familiarity(F.col("home_branch"), home, F.col("branch"), F.col("levels"), F.col("post_levels")))
    base = base.withColumn("levels_provided", kept_levels(F.col("levels"), F.col("familiar"), F.col("quality_tier"), seed, *key))
    style = F.floor(u(seed, "style", F.col("source_id")) * 5)
    unit = unit_text(F.col("levels_provided"), F.col("post_levels"), style)
    clutter = F.when(u(seed, "clutter", *key) < 0.15, F.lit("trans. pend.")).otherwise(F.lit(""))
    confounder = F.when(u(seed, "confounder", *key) < 0.15, F.concat(F.lit("see p. "), F.floor(u(seed, "page", *key) * 90 + 1).cast("string"))).otherwise(F.lit(""))
    gap = F.when(u(seed, "gap", *key) < 0.3, "  ").otherwise(" ")
    text = F.array_join(F.filter(F.array(F.col("name"), F.col("rank"), unit, clutter, confounder), lambda x: x != ""), " ")
    text = F.when(gap == "  ", F.regexp_replace(text, r"^(\S+ \S+) ", "$1  ")).otherwise(text)
    base = base.withColumn("raw_text", imperfect(text, F.col("quality_tier"), seed, *key))
    unique = F.filter(F.coalesce("own_terms", F.array().cast("array<string>")), lambda t: F.contains(F.lower("raw_text"), t))
    depth = F.size("levels_provided")
    signals = F.concat(
        F.transform(unique, lambda t: F.concat(F.lit("branch_unique:"), t)),
        F.array_compact(F.array(F.when(depth == 5, F.lit("depth:5")), F.when(depth == 4, F.lit("depth:4+")))),
    )
    return base.select(
        "source_id", "soldier_id", "state_id", "raw_text", "quality_tier",
        (depth / F.size("levels")).alias("path_completeness"), "levels_provided", signals.alias("extraction_signals"),
    )


def sequential_situations(people: DataFrame, situations: list[str], group: str, order: str, seed: int = 42) -> DataFrame:
    """Assign situations one after the other within a group: with 70 % a used one, weighted by the square
    root of its count, else any. Each choice depends on all before it, so it is a fold over the
    sorted rows of a group, in Arrow batches with one count per situation as its state."""
    import math
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, counts = object(), {}
        for frame in batches:
            out = []
            for key, draw, other in frame[[group, "_u1", "_u2"]].itertuples(index=False, name=None):
                if key != current:
                    current, counts = key, {}
                if counts and draw < RECENT_SHARE:
                    at = other * sum(math.sqrt(c) for c in counts.values())
                    for name, c in counts.items():
                        at -= math.sqrt(c)
                        if at <= 0:
                            break
                else:
                    name = situations[min(int(other * len(situations)), len(situations) - 1)]
                counts[name] = counts.get(name, 0) + 1
                out.append(name)
            yield frame.assign(situation=out)

    keyed = people.withColumns({"_u1": u(seed, "reuse", F.col(order)), "_u2": u(seed, "which", F.col(order))})
    ordered = keyed.repartition(group).sortWithinPartitions(group, order)
    return ordered.mapInPandas(run, StructType([*ordered.schema.fields]).add("situation", "string")).drop("_u1", "_u2")
