"""Thresholds, registry, hierarchy, conflicts, rules and glossary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import glossary, hierarchy, thresholds
from .base import DESIGNATORS, DIMS, ENTITIES, Tables, joined

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


THRESHOLDS = f"""{ENTITIES}, counts AS (
  SELECT component_id, count(DISTINCT soldier_id) AS n_entities FROM entities WHERE balance > 5000 GROUP BY component_id
), q AS (
  SELECT quantile_cont(n_entities, 0.25) AS p25, quantile_cont(n_entities, 0.5) AS median, quantile_cont(n_entities, 0.75) AS p75 FROM counts
), thresholds AS (
  SELECT component_id, n_entities, p25, median, p75, CASE WHEN median = 0 THEN 0 ELSE n_entities / median * 100 END AS pct_of_median,
         CASE WHEN n_entities >= p75 THEN 'well_represented' WHEN n_entities >= median THEN 'adequately_represented'
              WHEN n_entities >= p25 OR (CASE WHEN median = 0 THEN 0 ELSE n_entities / median * 100 END) >= 75 THEN 'under_represented' ELSE 'sparse' END AS tier
  FROM counts, q
)"""


def _thresholds(t: Tables) -> DataFrame:
    return thresholds.component_thresholds(t.rated())


@query(f"WITH {THRESHOLDS} SELECT component_id, CAST(n_entities AS BIGINT) AS n_entities, p25, median, p75, round(pct_of_median, 6) AS pct_of_median, tier FROM thresholds")
def component_thresholds(t):
    return _thresholds(t).withColumn("pct_of_median", F.round("pct_of_median", 6))


@query(f"""WITH {THRESHOLDS}, tiers(tier) AS (VALUES ('sparse'), ('under_represented'), ('adequately_represented'), ('well_represented'))
SELECT tiers.tier, CAST(count(component_id) AS BIGINT) AS n_components FROM tiers LEFT JOIN thresholds USING (tier) GROUP BY tiers.tier""")
def tier_histogram(t):
    return thresholds.tier_histogram(_thresholds(t))


@query(f"""WITH {THRESHOLDS}
SELECT component_id, tier, CAST(n_entities AS BIGINT) AS sample_size, round(pct_of_median, 1) AS pct_of_median,
       CASE WHEN tier IN ('well_represented', 'adequately_represented') THEN 'full' WHEN tier = 'under_represented' THEN 'limited' ELSE 'hierarchy_only' END AS generation_mode,
       CASE tier WHEN 'sparse' THEN 'under_represented' WHEN 'under_represented' THEN 'adequately_represented' END AS rebuild_when_tier,
       CASE tier WHEN 'sparse' THEN CAST(trunc(p25) AS INTEGER) WHEN 'under_represented' THEN CAST(trunc(median) AS INTEGER) END AS rebuild_when_sample_size,
       CASE WHEN tier IN ('well_represented', 'adequately_represented') THEN 'complete' WHEN tier = 'under_represented' THEN 'limited' ELSE 'not_generated' END AS patterns_section,
       CAST(CASE WHEN tier IN ('sparse', 'under_represented') THEN 3 ELSE 0 END AS BIGINT) AS n_recommendations,
       CAST(CASE WHEN tier = 'sparse' THEN 2 ELSE 0 END + CASE WHEN pct_of_median < 50 THEN 1 ELSE 0 END AS BIGINT) AS n_warnings
FROM thresholds""")
def registry_entries(t):
    found = thresholds.registry_entries(_thresholds(t))
    return found.select(
        "component_id", "tier", "sample_size", "pct_of_median", "generation_mode", "rebuild_when_tier", "rebuild_when_sample_size",
        F.col("sections.patterns").alias("patterns_section"), F.size("recommendations").cast("long").alias("n_recommendations"), F.size("warnings").cast("long").alias("n_warnings"),
    )


@query(f"""WITH {THRESHOLDS}, old_counts AS (
  SELECT component_id, count(DISTINCT soldier_id) AS n_entities FROM entities WHERE balance > 7000 AND component_id <> 'FRANCE' GROUP BY component_id
), old_q AS (
  SELECT quantile_cont(n_entities, 0.25) AS p25, quantile_cont(n_entities, 0.5) AS median, quantile_cont(n_entities, 0.75) AS p75 FROM old_counts
), old AS (
  SELECT component_id, CASE WHEN n_entities >= p75 THEN 'well' WHEN n_entities >= median THEN 'adequate' WHEN n_entities >= p25 OR n_entities / median * 100 >= 75 THEN 'under' ELSE 'sparse' END AS tier, p25, median
  FROM old_counts, old_q
), j AS (
  SELECT t.component_id, t.n_entities,
         CASE t.tier WHEN 'sparse' THEN 0 WHEN 'under_represented' THEN 1 WHEN 'adequately_represented' THEN 2 ELSE 3 END AS idx,
         old.component_id IS NULL AS fresh, CASE old.tier WHEN 'sparse' THEN 1 WHEN 'under' THEN 2 END AS want,
         CASE old.tier WHEN 'sparse' THEN trunc(p25_) WHEN 'under' THEN trunc(median_) END AS size
  FROM thresholds t LEFT JOIN (SELECT component_id, tier, p25 AS p25_, median AS median_ FROM old) old USING (component_id)
)
SELECT component_id, CASE WHEN fresh THEN 'new' WHEN idx >= want THEN 'tier' WHEN size > 0 AND n_entities >= size THEN 'size' END AS reason
FROM j WHERE fresh OR coalesce(idx >= want, false) OR coalesce(size > 0 AND n_entities >= size, false)""")
def rebuild_candidates(t):
    old = thresholds.component_thresholds(t.earlier())
    return thresholds.rebuild_candidates(_thresholds(t), thresholds.registry_entries(old))


def _sorted(column: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list({column}))), ',')"


@query(f"WITH {DIMS} SELECT level, {_sorted('branch')} AS appears_in, CASE WHEN count(DISTINCT branch) = 1 THEN min(branch) END AS unique_to FROM dims GROUP BY level")
def level_discriminators(t):
    return hierarchy.level_discriminators(t.dims()).withColumn("appears_in", joined("appears_in"))


@query(f"""WITH {DIMS} SELECT value, CASE WHEN regexp_matches(value, '^[0-9]+$') THEN 'numeric' WHEN regexp_matches(value, '^\\p{{L}}$') THEN 'alpha' ELSE 'word' END AS type,
CASE WHEN count(DISTINCT branch) = 1 THEN min(branch) END AS unique_to_branch, {_sorted("branch || '.' || level")} AS collision_levels, CAST(count(DISTINCT branch) AS BIGINT) AS n_branches
FROM dims GROUP BY value""")
def designator_discriminators(t):
    found = hierarchy.designator_discriminators(t.dims())
    places = F.array_sort(F.transform("collision_levels", lambda x: F.concat_ws(".", x["branch"], x["level"])))
    return found.select("value", "type", "unique_to_branch", joined(places).alias("collision_levels"), F.size("valid_in").cast("long").alias("n_branches"))


@query(f"WITH {DIMS} SELECT CAST(depth AS INTEGER) AS depth, {_sorted('branch')} AS branches, count(DISTINCT branch) = 1 AS is_unique FROM dims GROUP BY depth")
def depth_discriminators(t):
    return hierarchy.depth_discriminators(t.dims()).withColumn("branches", joined("branches"))


INDEX = f"SELECT level, value, {_sorted('''branch || '.' || level''')} AS members FROM dims GROUP BY level, value HAVING count(DISTINCT branch) >= 2"


@query(f"WITH {DIMS} {INDEX}")
def collision_index(t):
    return hierarchy.collision_index(t.dims()).withColumn("members", joined("members"))


@query(f"WITH {DESIGNATORS} SELECT level, value, {_sorted('component')} AS members FROM designators GROUP BY level, value HAVING count(DISTINCT component) >= 2")
def component_collisions(t):
    return hierarchy.component_collisions(t.component_designators()).withColumn("members", joined("members"))


@query(f"""WITH {DESIGNATORS}, {DIMS}, u AS (
  SELECT level, value, branch || '.' || level AS member FROM dims WHERE (level, value) IN (SELECT (level, value) FROM dims GROUP BY level, value HAVING count(DISTINCT branch) >= 2)
  UNION SELECT level, value, component FROM designators WHERE (level, value) IN (SELECT (level, value) FROM designators GROUP BY level, value HAVING count(DISTINCT component) >= 2)
) SELECT level, value, {_sorted('member')} AS members FROM u GROUP BY level, value""")
def merged_collision_index(t):
    merged = hierarchy.merge_indexes(hierarchy.collision_index(t.dims()), hierarchy.component_collisions(t.component_designators()))
    return merged.withColumn("members", joined("members"))


@query(f"WITH {DESIGNATORS} SELECT DISTINCT comp_a, comp_b FROM edges")
def collision_pairs(t):
    return hierarchy.collision_pairs(hierarchy.conflict_edges(t.component_designators()))


@query(f"WITH {DESIGNATORS}, sides AS (SELECT comp_a AS component, comp_b AS rival FROM edges UNION SELECT comp_b, comp_a FROM edges) SELECT component, {_sorted('rival')} AS rivals FROM sides GROUP BY component")
def component_rivals(t):
    return hierarchy.rivals(hierarchy.conflict_edges(t.component_designators())).withColumn("rivals", joined("rivals"))


@query(f"WITH {DESIGNATORS} SELECT comp_a, comp_b, {_sorted("level || '=' || value")} AS shared FROM edges GROUP BY comp_a, comp_b")
def pair_collision_levels(t):
    found = hierarchy.pair_levels(hierarchy.conflict_edges(t.component_designators()))
    return found.withColumn("shared", joined(F.array_sort(F.transform("shared", lambda x: F.concat_ws("=", x["level"], x["value"])))))


RULES = f"""{DIMS}, b AS (SELECT DISTINCT branch AS excludes_branch, depth AS own_depth FROM dims),
lv AS (SELECT level AS token, min(branch) AS implies_branch FROM dims GROUP BY level HAVING count(DISTINCT branch) = 1),
dv AS (SELECT value AS token, min(branch) AS implies_branch FROM dims GROUP BY value HAVING count(DISTINCT branch) = 1),
rules AS (
  SELECT 'term_presence' AS rule_type, excludes_branch, implies_branch, token, CAST(NULL AS INTEGER) AS depth, 'contains term ''' || token || '''' AS condition, 1 AS rule_order
  FROM lv JOIN b ON implies_branch <> excludes_branch
  UNION ALL SELECT 'designator_invalidity', excludes_branch, implies_branch, token, NULL, 'contains designator ''' || token || ''' (only valid in ' || implies_branch || ')', 2
  FROM dv JOIN b ON implies_branch <> excludes_branch
  UNION ALL SELECT 'depth_mismatch', excludes_branch, NULL, NULL, d.depth, 'path has ' || d.depth || ' levels (branch only has ' || own_depth || ')', 3
  FROM (SELECT DISTINCT depth FROM dims) d JOIN b ON d.depth > own_depth
)"""


@query(f"WITH {RULES} SELECT rule_type, excludes_branch, implies_branch, token, CAST(depth AS INTEGER) AS depth, condition FROM rules")
def exclusion_rules(t):
    return hierarchy.exclusion_rules(t.dims()).select("rule_type", "excludes_branch", "implies_branch", "token", "depth", "condition")


@query(f"""WITH {DIMS}, everywhere AS (SELECT DISTINCT level, value FROM dims), own AS (SELECT DISTINCT branch, level FROM dims)
SELECT o.branch, o.level, coalesce(array_to_string(list_sort(list(e.value) FILTER (d.value IS NULL)), ','), '') AS invalid
FROM own o JOIN everywhere e USING (level) LEFT JOIN dims d ON d.branch = o.branch AND d.level = o.level AND d.value = e.value GROUP BY o.branch, o.level""")
def invalid_designators(t):
    return hierarchy.invalid_designators(t.dims()).withColumn("invalid", joined("invalid"))


@query(f"""WITH {DIMS}, d AS (SELECT DISTINCT branch, level, value FROM dims WHERE branch IN ('ASIA', 'EUROPE')), l AS (SELECT DISTINCT level FROM dims)
SELECT l.level, coalesce((SELECT array_to_string(list_sort(list(value)), ',') FROM d x WHERE x.level = l.level AND branch = 'ASIA' AND NOT EXISTS (SELECT 1 FROM d y WHERE y.level = x.level AND y.value = x.value AND y.branch = 'EUROPE')), '') AS only_a,
       coalesce((SELECT array_to_string(list_sort(list(value)), ',') FROM d x WHERE x.level = l.level AND branch = 'EUROPE' AND NOT EXISTS (SELECT 1 FROM d y WHERE y.level = x.level AND y.value = x.value AND y.branch = 'ASIA')), '') AS only_b FROM l""")
def unique_designators(t):
    found = hierarchy.unique_designators(t.dims(), "ASIA", "EUROPE")
    return found.withColumns({"only_a": joined("only_a"), "only_b": joined("only_b")})


@query(f"""WITH {DIMS}, b AS (SELECT DISTINCT branch AS excludes_branch, depth AS own_depth FROM dims),
lv AS (SELECT level AS token, min(branch) AS implies_branch FROM dims GROUP BY level HAVING count(DISTINCT branch) = 1)
SELECT 'term_presence' AS rule_type, excludes_branch, token, CAST(NULL AS INTEGER) AS depth FROM lv JOIN b ON implies_branch <> excludes_branch
UNION SELECT 'depth_mismatch', excludes_branch, NULL, CAST(d.depth AS INTEGER) FROM (SELECT DISTINCT depth FROM dims) d JOIN b ON d.depth <> own_depth""")
def peer_exclusions(t):
    return hierarchy.peer_exclusions(t.dims()).select("rule_type", "excludes_branch", "token", "depth")


@query(f"""WITH {DIMS}, l AS (SELECT level, min(branch) AS branch FROM dims GROUP BY level HAVING count(DISTINCT branch) = 1) SELECT branch, level AS term FROM l""")
def branch_discriminators(t):
    dims = t.dims()
    return hierarchy.branch_discriminators(hierarchy.exclusion_rules(dims), dims)


TERMS = f"""{DIMS}, titled AS (
  SELECT branch AS raw, 'Organization Term' AS term_type, 1 AS p FROM dims UNION SELECT level, 'Unit Term', 2 FROM dims
  UNION SELECT value, 'Unit Term', 3 FROM dims WHERE NOT regexp_matches(value, '^[0-9]+$') AND NOT regexp_matches(value, '^\\p{{L}}$')
), named AS (
  SELECT array_to_string(list_transform(string_split(replace(raw, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS full_term, term_type, p FROM titled
)"""


@query(f"WITH {TERMS} SELECT full_term, arg_min(term_type, p) AS term_type, '' AS abbreviations FROM named GROUP BY full_term")
def glossary_terms(t):
    return glossary.glossary_terms(t.dims()).select("full_term", "term_type", joined("abbreviations").alias("abbreviations"))


@query(f"WITH {DIMS} SELECT component, level, value FROM (SELECT DISTINCT branch || '/' || value AS component, branch, 'nation' AS level, value FROM dims WHERE level = 'nation')")
def component_paths(t):
    dims = t.dims()
    paths = dims.where("level = 'nation'").select(F.concat_ws("/", "branch", "value").alias("component"))
    return hierarchy.component_designators(paths, dims).select("component", "level", "value")


@query(f"""WITH {DIMS} SELECT lower(level) AS level, CASE WHEN regexp_matches(trim(value), '^[0-9]+$') THEN CAST(CAST(trim(value) AS BIGINT) AS VARCHAR) ELSE upper(trim(value)) END AS value, CAST(count(DISTINCT branch) AS BIGINT) AS n_branches FROM dims GROUP BY 1, 2""")
def valid_designators(t):
    found = hierarchy.valid_designators(t.dims(), by_branch=True)
    return found.groupBy("level", "value").agg(F.count_distinct("branch").alias("n_branches"))
