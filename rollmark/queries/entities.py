"""Difficulty, splits, samples and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.relational import first_per
from ..operators import batching, difficulty, hierarchy, sampling
from ..plans import pipelines
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


# ---- inferred difficulty: suppliers, whose signals are their nation, a brand and a few terms ----


def _canonical(t: Tables):
    nation = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    size = F.format_string("%02d", (F.col("s_suppkey") % 50 + 1).cast("int"))
    brand = F.format_string("Brand#%d", (F.col("s_suppkey") % 25 + 1).cast("int"))
    kind = F.col("s_suppkey") % 7
    none = F.array().cast("array<string>")
    return nation.select(
        F.col("s_suppkey").alias("soldier_id"),
        F.when(kind == 0, F.array(F.concat(F.lit("Nation:"), F.col("n_name")))).when(kind == 1, F.array(F.concat(F.lit("BRAND:"), brand), F.lit("Ship:9"))).when(
            kind == 5, F.array(F.lit("segment:BUILDING"), F.concat(F.lit("size:"), size))
        ).otherwise(none).alias("Unit_Term_Digit_Term:Pair"),
        F.when(kind == 2, F.array(F.lower("n_name"), F.lit(" "))).when(kind == 5, F.array(brand)).when(kind == 6, F.array(F.lit("machinery"), F.col("n_name"))).otherwise(none).alias("Unchar_Alpha"),
        F.when(kind.isin(1, 3), F.array(size)).otherwise(none).alias("Unchar_Digits"),
        F.when(kind == 4, F.array(F.lit("POST_AME"), brand)).when(kind == 6, F.array(F.lit("SEGMENT"))).otherwise(none).alias("Unit_Terms"),
        none.alias("Org_Terms"),
    )


CANONICAL = """sup AS (
  SELECT s_suppkey AS e, n_name, s_suppkey % 7 AS kind, lpad(CAST(s_suppkey % 50 + 1 AS VARCHAR), 2, '0') AS size, 'Brand#' || (s_suppkey % 25 + 1) AS brand
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
), raw_pairs AS (
  SELECT e, 'nation' AS l, n_name AS v FROM sup WHERE kind = 0 UNION ALL SELECT e, 'brand', brand FROM sup WHERE kind = 1 UNION ALL SELECT e, 'ship', '9' FROM sup WHERE kind = 1
  UNION ALL SELECT e, 'segment', 'BUILDING' FROM sup WHERE kind = 5 UNION ALL SELECT e, 'size', size FROM sup WHERE kind = 5
), raw_values AS (
  SELECT e, lower(n_name) AS v FROM sup WHERE kind = 2 UNION ALL SELECT e, brand FROM sup WHERE kind = 5 UNION ALL SELECT e, 'machinery' FROM sup WHERE kind = 6 UNION ALL SELECT e, n_name FROM sup WHERE kind = 6
  UNION ALL SELECT e, size FROM sup WHERE kind IN (1, 3)
), raw_units AS (
  SELECT e, 'POST_AME' AS v FROM sup WHERE kind = 4 UNION ALL SELECT e, brand FROM sup WHERE kind = 4 UNION ALL SELECT e, 'SEGMENT' FROM sup WHERE kind = 6
)"""


def _canon(x: str) -> str:
    return f"(CASE WHEN regexp_matches(trim({x}), '^[0-9]+$') THEN CAST(CAST(trim({x}) AS BIGINT) AS VARCHAR) ELSE nullif(upper(trim({x})), '') END)"


INFERRED = f"""WITH {DIMS}, {CANONICAL}, names AS (SELECT DISTINCT lower(level) AS l FROM dims),
valid AS (SELECT DISTINCT branch, lower(level) AS l, {_canon('value')} AS v FROM dims),
depths AS (SELECT DISTINCT branch, depth FROM dims),
pairs AS (SELECT DISTINCT e, l, {_canon('v')} AS v FROM raw_pairs WHERE l IN (SELECT l FROM names)),
vals AS (SELECT DISTINCT e, v FROM (SELECT e, {_canon('v')} AS v FROM raw_values UNION ALL SELECT e, {_canon('v')} FROM raw_units WHERE lower(v) NOT IN (SELECT l FROM names)) WHERE v IS NOT NULL),
terms AS (SELECT DISTINCT e, lower(v) AS term, {_canon('v')} AS v FROM raw_units),
vlev AS (SELECT DISTINCT vals.e, vals.v, valid.l FROM vals JOIN valid USING (v)),
vsize AS (SELECT vals.e, vals.v, count(DISTINCT valid.l) AS n FROM vals LEFT JOIN valid USING (v) GROUP BY vals.e, vals.v),
idx AS (SELECT lower(level) AS l, {_canon('value')} AS v, branch FROM dims WHERE (level, value) IN (SELECT (level, value) FROM dims GROUP BY level, value HAVING count(DISTINCT branch) >= 2)),
hits AS (SELECT DISTINCT e, branch FROM (SELECT e, l, v FROM pairs UNION SELECT e, l, v FROM vlev) p JOIN idx USING (l, v)),
cand AS (SELECT e, branch FROM hits UNION SELECT e, branch FROM sup, (SELECT DISTINCT branch FROM dims) b WHERE e NOT IN (SELECT e FROM hits)),
ext AS (SELECT e, (SELECT count(DISTINCT l) FROM pairs p WHERE p.e = sup.e) + (SELECT count(*) FROM vsize s WHERE s.e = sup.e AND s.n = 1) AS d,
          EXISTS (SELECT 1 FROM pairs p WHERE p.e = sup.e) OR EXISTS (SELECT 1 FROM vlev x WHERE x.e = sup.e) OR EXISTS (SELECT 1 FROM terms x WHERE x.e = sup.e) AS has_any FROM sup),
excl AS (SELECT e, v FROM vals UNION SELECT e, v FROM terms),
lv AS (SELECT lower(level) AS token, min(branch) AS b FROM dims GROUP BY level HAVING count(DISTINCT branch) = 1),
dv AS (SELECT {_canon('value')} AS token, min(branch) AS b FROM dims GROUP BY value HAVING count(DISTINCT branch) = 1),
gone AS (
  SELECT cand.e, cand.branch FROM cand JOIN ext USING (e) JOIN depths USING (branch) WHERE d > depth
  UNION SELECT cand.e, cand.branch FROM cand JOIN terms USING (e) JOIN lv ON lv.token = term AND lv.b <> cand.branch
  UNION SELECT cand.e, cand.branch FROM cand JOIN excl USING (e) JOIN dv ON dv.token = excl.v AND dv.b <> cand.branch
  UNION SELECT cand.e, cand.branch FROM cand JOIN ext USING (e) JOIN depths USING (branch) WHERE d > 0 AND d > depth AND d IN (SELECT depth FROM depths)
), rest AS (SELECT e, branch FROM cand EXCEPT SELECT e, branch FROM gone),
here AS (SELECT DISTINCT rest.e, rest.branch, vals.v, valid.l FROM rest JOIN vals USING (e) JOIN valid ON valid.branch = rest.branch AND valid.v = vals.v),
heren AS (SELECT e, branch, v, count(*) AS n FROM here GROUP BY e, branch, v),
conf AS (
  SELECT rest.e, rest.branch, l, 1.0 AS c FROM rest JOIN pairs USING (e) WHERE l IN (SELECT l FROM valid v WHERE v.branch = rest.branch)
  UNION ALL SELECT here.e, here.branch, l, CASE WHEN n = 1 THEN 0.75 ELSE 0.25 END FROM here JOIN heren USING (e, branch, v)
), best AS (SELECT e, branch, l, max(c) AS c FROM conf GROUP BY e, branch, l),
scores AS (
  SELECT rest.e, rest.branch, CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.e = rest.e AND NOT EXISTS (SELECT 1 FROM valid v WHERE v.branch = rest.branch AND v.l = p.l AND v.v = p.v)) THEN 0.0
         ELSE coalesce((SELECT sum(c) FROM best WHERE best.e = rest.e AND best.branch = rest.branch), 0) / least(depth, 4) END AS score
  FROM rest JOIN depths USING (branch)
), final AS (
  SELECT sup.e, (sup.e IN (SELECT e FROM hits)) OR NOT has_any AS collision, has_any, (SELECT count(*) FROM rest WHERE rest.e = sup.e) AS n_rest,
         coalesce((SELECT max(score) FROM scores WHERE scores.e = sup.e), 0) AS score,
         coalesce((SELECT array_to_string(list_sort(list(branch)), ',') FROM rest WHERE rest.e = sup.e), '') AS candidates
  FROM sup JOIN ext USING (e)
)
SELECT e AS soldier_id, collision, round(CAST(score AS DOUBLE), 6) AS score, n_rest = 1 AS resolvable, candidates,
       CASE WHEN NOT has_any THEN 'extreme' WHEN NOT collision THEN 'easy' WHEN n_rest = 1 THEN 'moderate' WHEN score >= 0.7 THEN 'moderate' WHEN score >= 0.4 THEN 'hard' ELSE 'extreme' END AS tier
FROM final"""


@query(INFERRED)
def inferred_difficulty(t):
    found = pipelines.inferred_difficulty(_canonical(t), t.dims())
    return found.select(
        "soldier_id",
        F.col("inferred_collision_position").alias("collision"),
        F.round("inferred_complementarity_score", 6).alias("score"),
        F.col("inferred_structural_resolvability").alias("resolvable"),
        joined("inferred_candidate_branches").alias("candidates"),
        F.col("inferred_difficulty_tier").alias("tier"),
    )


# ---- ground truth difficulty: customers with one state per order status ----


def _states(t: Tables):
    """soldier_id, state_id, branch, post_levels: a customer's orders of one status are a state."""
    rows = t.orders.join(t.entities(), F.col("o_custkey") == F.col("soldier_id"))
    state = rows.select("soldier_id", F.concat_ws("-", F.col("soldier_id").cast("string"), "o_orderstatus").alias("state_id"), "branch", "component_id", "segment").distinct()
    return state.withColumn("post_levels", F.create_map(F.lit("nation"), F.col("component_id"), F.lit("segment"), F.col("segment")))


def _gt_records(t: Tables):
    """A record per order: the levels that its priority lets it give."""
    rows = t.orders.join(t.entities(), F.col("o_custkey") == F.col("soldier_id"))
    tier = F.substring("o_orderpriority", 1, 1).cast("int")
    levels = F.when(tier <= 2, F.array(F.lit("nation"), F.lit("segment"))).when(tier == 3, F.array(F.lit("segment"))).otherwise(F.array(F.lit("nation")))
    signals = F.when(F.col("o_totalprice") > 495000, F.array(F.lit("depth:5"))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "soldier_id", F.concat_ws("-", F.col("soldier_id").cast("string"), "o_orderstatus").alias("state_id"), levels.alias("levels_provided"),
        (F.size(levels) / 2 - F.when(F.col("o_totalprice") < 480000, 0.25).otherwise(0.0)).alias("path_completeness"), signals.alias("extraction_signals"),
        F.concat_ws(" ", "o_orderpriority", "segment").alias("raw_text"),
    )


def _gt_index(t: Tables):
    """Names section: segments, held by each branch; numbers never match."""
    return t.entities().select(F.lit("names").alias("section"), F.col("segment").alias("designator"), "branch", F.lit("segment").alias("level")).where("segment IN ('BUILDING', 'MACHINERY')").distinct()


GT = f"""WITH {ENTITIES}, st AS (
  SELECT DISTINCT soldier_id, soldier_id || '-' || o_orderstatus AS state_id, branch, component_id, segment FROM orders JOIN entities ON o_custkey = soldier_id
), rec AS (
  SELECT soldier_id, soldier_id || '-' || o_orderstatus AS state_id, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS tier, o_totalprice, o_orderpriority || ' ' || segment AS raw_text, branch FROM orders JOIN entities ON o_custkey = soldier_id
), idx AS (SELECT DISTINCT segment AS designator, branch FROM entities WHERE segment IN ('BUILDING', 'MACHINERY')),
idxn AS (SELECT designator, count(*) AS n FROM idx GROUP BY designator),
sev AS (
  SELECT soldier_id, state_id, branch, CASE WHEN EXISTS (SELECT 1 FROM idx WHERE designator = segment AND idx.branch <> st.branch) THEN 'cross_branch'
    WHEN coalesce(n, 0) <= 1 THEN 'none' WHEN n = 2 THEN 'low' WHEN n = 3 THEN 'medium' ELSE 'high' END AS severity FROM st LEFT JOIN idxn ON designator = segment
), lev AS (
  SELECT soldier_id, state_id, 'nation' AS l FROM rec WHERE tier <> 3 UNION ALL SELECT soldier_id, state_id, 'segment' FROM rec WHERE tier <= 3
), cnt AS (SELECT soldier_id, state_id, l, count(*) AS n FROM lev GROUP BY ALL),
per_state AS (SELECT soldier_id, state_id, count(*) AS levels, avg(n) AS mean FROM cnt GROUP BY ALL),
per AS (
  SELECT st.soldier_id, avg(coalesce(levels / 2.0, 0)) AS cov, avg(coalesce(greatest(0, mean - 1) / mean, 0)) AS red FROM st LEFT JOIN per_state USING (soldier_id, state_id) GROUP BY st.soldier_id
), res AS (
  SELECT soldier_id, bool_or(o_totalprice > 495000 OR (branch = 'ASIA' AND contains(lower(raw_text), 'urgent'))) AS resolvable,
         bool_or((CASE WHEN tier <= 2 THEN 1.0 ELSE 0.5 END) - CASE WHEN o_totalprice < 480000 THEN 0.25 ELSE 0 END >= 0.95) AS complete FROM rec GROUP BY soldier_id
), agg AS (
  SELECT soldier_id, bool_or(severity <> 'none') AS zone, arg_max(severity, list_position(['none', 'low', 'medium', 'high', 'cross_branch'], severity)) AS worst FROM sev GROUP BY soldier_id
), tiers AS (
  SELECT soldier_id, cov / (1 + red) AS score, resolvable, CASE
    WHEN complete AND NOT zone THEN 'easy' WHEN complete AND zone AND resolvable THEN 'easy' WHEN cov / (1 + red) > 0.8 AND NOT zone THEN 'easy'
    WHEN resolvable AND cov / (1 + red) > 0.5 THEN 'easy' WHEN complete AND zone THEN 'moderate' WHEN NOT zone AND cov / (1 + red) > 0.5 THEN 'moderate'
    WHEN zone AND cov / (1 + red) > 0.6 THEN 'moderate' WHEN resolvable THEN 'moderate' WHEN worst = 'cross_branch' AND cov / (1 + red) < 0.3 THEN 'extreme'
    WHEN zone AND cov / (1 + red) < 0.3 THEN 'extreme' ELSE 'hard' END AS tier
  FROM per JOIN res USING (soldier_id) JOIN agg USING (soldier_id)
)
SELECT state_id, soldier_id, branch, severity, severity <> 'none' AS zone, round(score, 6) AS score, resolvable, tier FROM sev JOIN tiers USING (soldier_id)"""


@query(GT)
def gt_difficulty(t):
    depths = t.region.select(F.col("r_name").alias("branch"), F.lit(2).alias("depth"))
    terms = t.region.where("r_name = 'ASIA'").select(F.col("r_name").alias("branch"), F.lit("Urgent").alias("term"))
    found = difficulty.gt_difficulty(_states(t), _gt_records(t), depths, _gt_index(t), terms)
    return found.select(
        "state_id", "soldier_id", "branch", F.col("gt_collision_severity").alias("severity"), F.col("gt_collision_zone_flag").alias("zone"),
        F.round("gt_complementarity_score", 6).alias("score"), F.col("gt_structural_resolvability").alias("resolvable"), F.col("gt_difficulty_tier").alias("tier"),
    )


@query(f"""WITH {ENTITIES}, idx AS (SELECT DISTINCT segment AS designator, branch FROM entities WHERE segment IN ('BUILDING', 'MACHINERY')),
st AS (SELECT DISTINCT soldier_id, soldier_id || '-' || o_orderstatus AS state_id, branch, segment FROM orders JOIN entities ON o_custkey = soldier_id)
SELECT state_id, array_to_string(list_sort(list(DISTINCT idx.branch || '.segment:' || designator)), ',') AS paths FROM st JOIN idx ON designator = segment AND idx.branch <> st.branch GROUP BY state_id""")
def colliding_paths(t):
    return difficulty.colliding_paths(_states(t), _gt_index(t)).select("state_id", joined("paths").alias("paths"))


# ---- splits ----


@query(f"""WITH {ENTITIES}, s AS (SELECT component_id, segment, soldier_id, count(*) OVER (PARTITION BY component_id) AS cn, count(*) OVER (PARTITION BY component_id, segment) AS n,
  row_number() OVER (PARTITION BY component_id, segment ORDER BY md5('42:' || soldier_id), soldier_id) AS nth FROM entities)
SELECT component_id, segment, soldier_id, CASE WHEN nth <= CASE WHEN cn < 10 OR n < 4 THEN 0 ELSE least(greatest(1, CAST(floor(n * 0.2 + 1e-9) AS INTEGER)), n - 1) END THEN 'test' ELSE 'train' END AS split FROM s""")
def stratified_split(t):
    return sampling.stratified_split(t.entities(), stratum="segment")


@query(f"""WITH {ENTITIES}, s AS (SELECT component_id, soldier_id, count(*) OVER (PARTITION BY component_id) AS n, row_number() OVER (PARTITION BY component_id ORDER BY md5('42:' || soldier_id), soldier_id) AS nth FROM entities)
SELECT component_id, soldier_id, CASE WHEN nth <= CASE WHEN n < 2 THEN 0 ELSE greatest(1, least(round_even(round(n * (1 - 0.7), 9), 0), n - 1)) END THEN 'test' ELSE 'train' END AS split FROM s""")
def train_test_split(t):
    return sampling.component_split(t.entities())


@query("SELECT CAST(0 AS BIGINT) AS n_leaked, CAST(count(DISTINCT c_custkey) AS BIGINT) AS n_entities FROM customer")
def split_leakage_check(t):
    split = sampling.stratified_split(t.entities(), stratum="segment")
    leaked = sampling.leakage(split).agg(F.count(F.lit(1)).alias("n_leaked"))
    return leaked.join(F.broadcast(split.agg(F.count_distinct("soldier_id").alias("n_entities"))))


@query("""SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)""")
def with_difficulty(t):
    return sampling.with_difficulty(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query("SELECT source, doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def rows_of_split(t):
    return sampling.rows_of(t.documents.select("source", "doc_id"), t.labels.where("quality = 1"), "doc_id")


# ---- quality-tier samples: orders of a customer, the priority's digit is the tier ----

ORDERS = "o AS (SELECT o_custkey, o_orderkey, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS tier FROM orders)"


def _tiered(t: Tables):
    return t.orders.select("o_custkey", "o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("tier"))


@query(f"WITH {ORDERS} SELECT o_custkey, o_orderkey, tier FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY tier DESC, o_orderkey) <= 5")
def quality_topn_vocab(t):
    return sampling.quality_vocab(_tiered(t), ["o_custkey"], 5, "tier", F.col("o_orderkey"))


@query(f"""WITH {ORDERS}, r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, tier ORDER BY o_orderkey) AS k FROM o WHERE tier BETWEEN 2 AND 5)
SELECT o_custkey, o_orderkey, tier FROM r WHERE tier > 2 OR k <= 1 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY tier DESC, k) <= 6""")
def quality_topn_diff(t):
    return sampling.quality_differentiator(_tiered(t), ["o_custkey"], 6, "tier", F.col("o_orderkey"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY md5('7:' || event_id), event_id) <= 4")
def sample_per_group(t):
    return sampling.sample_per_group(t.events.select("user_id", "event_id"), ["user_id"], 4, "event_id", 7)


@query(f"""WITH {ENTITIES}, ids AS (SELECT component_id, soldier_id FROM entities QUALIFY row_number() OVER (PARTITION BY component_id ORDER BY md5('42:' || soldier_id), soldier_id) <= 10)
SELECT component_id, soldier_id, o_orderkey FROM ids JOIN orders ON o_custkey = soldier_id QUALIFY row_number() OVER (PARTITION BY component_id, soldier_id ORDER BY md5('42:' || o_orderkey), o_orderkey) <= 3""")
def vocabulary_sample(t):
    raw = t.orders.select(F.col("o_custkey").alias("soldier_id"), "o_orderkey")
    return sampling.sample_for_vocabulary(t.entities(), raw, "component_id", "soldier_id", "o_orderkey", 10, 3).select("component_id", "soldier_id", "o_orderkey")


# quotas for weights extreme .5, hard .3, easy .2 over tiers by balance; two rounds of dealing are
# enough unless two tiers fill up one after the other, which the third round covers
_DEAL = """r{i} AS (
  SELECT *, k - (a{p} + b{p} + c{p}) AS left{i}, (CASE WHEN a{p} < na THEN 0.2 ELSE 0 END + CASE WHEN b{p} < nb THEN 0.5 ELSE 0 END + CASE WHEN c{p} < nc THEN 0.3 ELSE 0 END) AS w{i} FROM {src}
), s{i} AS (
  SELECT *, CASE WHEN a{p} < na AND w{i} > 0 THEN left{i} * (CAST(0.2 AS DOUBLE) / CAST(w{i} AS DOUBLE)) ELSE 0 END AS ra{i}, CASE WHEN b{p} < nb AND w{i} > 0 THEN left{i} * (CAST(0.5 AS DOUBLE) / CAST(w{i} AS DOUBLE)) ELSE 0 END AS rb{i},
            CASE WHEN c{p} < nc AND w{i} > 0 THEN left{i} * (CAST(0.3 AS DOUBLE) / CAST(w{i} AS DOUBLE)) ELSE 0 END AS rc{i} FROM r{i}
), u{i} AS (
  SELECT *, left{i} - floor(ra{i}) - floor(rb{i}) - floor(rc{i}) AS spare{i},
    CASE WHEN a{p} < na THEN ra{i} - floor(ra{i}) ELSE -1 END AS fa{i}, CASE WHEN b{p} < nb THEN rb{i} - floor(rb{i}) ELSE -1 END AS fb{i}, CASE WHEN c{p} < nc THEN rc{i} - floor(rc{i}) ELSE -1 END AS fc{i} FROM s{i}
), v{i} AS (
  SELECT *, a{p} + CASE WHEN left{i} > 0 THEN least(floor(ra{i}) + CASE WHEN fa{i} >= 0 AND (CASE WHEN fb{i} >= fa{i} THEN 1 ELSE 0 END + CASE WHEN fc{i} >= fa{i} THEN 1 ELSE 0 END) < spare{i} THEN 1 ELSE 0 END, na - a{p}) ELSE 0 END AS a{i},
            b{p} + CASE WHEN left{i} > 0 THEN least(floor(rb{i}) + CASE WHEN fb{i} >= 0 AND (CASE WHEN fa{i} > fb{i} THEN 1 ELSE 0 END + CASE WHEN fc{i} >= fb{i} THEN 1 ELSE 0 END) < spare{i} THEN 1 ELSE 0 END, nb - b{p}) ELSE 0 END AS b{i},
            c{p} + CASE WHEN left{i} > 0 THEN least(floor(rc{i}) + CASE WHEN fc{i} >= 0 AND (CASE WHEN fa{i} > fc{i} THEN 1 ELSE 0 END + CASE WHEN fb{i} > fc{i} THEN 1 ELSE 0 END) < spare{i} THEN 1 ELSE 0 END, nc - c{p}) ELSE 0 END AS c{i} FROM u{i}
)"""
_DEALS = ", ".join(_DEAL.replace("{i}", str(i)).replace("{p}", str(i - 1)).replace("{src}", "zero" if i == 1 else f"v{i - 1}") for i in (1, 2, 3))


@query(f"""WITH {ENTITIES}, pool AS (
  SELECT component_id, soldier_id, CASE WHEN balance < -500 THEN 'extreme' WHEN balance < 1000 THEN 'hard' WHEN balance < 6000 THEN 'easy' END AS tier FROM entities
), zero AS (
  SELECT component_id, count(*) AS n, count(*) FILTER (tier = 'easy') AS na, count(*) FILTER (tier = 'extreme') AS nb, count(*) FILTER (tier = 'hard') AS nc, 12 AS k, 0 AS a0, 0 AS b0, 0 AS c0 FROM pool GROUP BY component_id
), {_DEALS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY component_id, coalesce(tier, '') ORDER BY md5('42:' || soldier_id), soldier_id) AS nth FROM pool
)
SELECT component_id, soldier_id, tier, n <= k AS undersampled FROM ranked JOIN v3 USING (component_id)
WHERE n <= k OR nth <= CASE tier WHEN 'easy' THEN a3 WHEN 'extreme' THEN b3 WHEN 'hard' THEN c3 ELSE k - a3 - b3 - c3 END""")
def stratified_quota_sample(t):
    tier = F.when(F.col("balance") < -500, "extreme").when(F.col("balance") < 1000, "hard").when(F.col("balance") < 6000, "easy")
    pool = t.entities().withColumn("tier", tier)
    return sampling.quota_sample(pool, ["component_id"], "soldier_id", "tier", {"extreme": 0.5, "hard": 0.3, "easy": 0.2}, 12)


SAMPLES = f"""{DESIGNATORS}, members AS (
  SELECT component_id AS component, soldier_id AS id, 'segment' AS level, segment AS value FROM entities
), sides AS (
  SELECT comp_a, comp_b, level, value, 'a' AS side, comp_a AS component FROM edges UNION ALL SELECT comp_a, comp_b, level, value, 'b', comp_b FROM edges
), inside AS (SELECT DISTINCT comp_a, comp_b, side, component, id FROM sides JOIN members USING (component, level, value)),
miss AS (SELECT DISTINCT s.comp_a, s.comp_b, s.side, s.component FROM sides s WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.comp_a = s.comp_a AND i.comp_b = s.comp_b AND i.side = s.side)),
pool AS (SELECT comp_a, comp_b, side, id FROM inside UNION SELECT comp_a, comp_b, side, id FROM miss JOIN members USING (component))"""


@query(f"""WITH {SAMPLES} SELECT comp_a, comp_b, side, id, count(*) OVER (PARTITION BY comp_a, comp_b, side) <= 4 AS undersampled
FROM pool QUALIFY row_number() OVER (PARTITION BY comp_a, comp_b, side ORDER BY md5('42:' || id), id) <= 4""")
def collision_samples(t):
    members = t.entities().select(F.col("component_id").alias("component"), F.col("soldier_id").alias("id"), F.lit("segment").alias("level"), F.col("segment").alias("value"))
    return sampling.collision_samples(members, hierarchy.conflict_edges(t.component_designators()), 4)


@query("""SELECT c_mktsegment, c_custkey FROM customer WHERE c_acctbal > 0
QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY -ln(greatest(CAST('0x' || substring(md5('5:' || c_custkey), 1, 8) AS BIGINT) / 4294967296.0, 1e-12)) / c_acctbal, c_custkey) <= 6""")
def weighted_sample(t):
    return sampling.weighted_sample(t.customer, ["c_mktsegment"], 6, F.col("c_acctbal"), "c_custkey", 5).select("c_mktsegment", "c_custkey")


# ---- batches ----

NEXT_FIT = """WITH RECURSIVE items AS (
  SELECT {group} AS g, {id} AS id, {size} AS size, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rn FROM ({source}) GROUP BY {group}, {id}
), walk AS (
  SELECT g, id, size, rn, 0 AS batch, size AS held, 1 AS cnt FROM items WHERE rn = 1
  UNION ALL SELECT i.g, i.id, i.size, i.rn, CASE WHEN w.held + i.size > {limit} OR w.cnt >= {most} THEN w.batch + 1 ELSE w.batch END,
    CASE WHEN w.held + i.size > {limit} OR w.cnt >= {most} THEN i.size ELSE w.held + i.size END, CASE WHEN w.held + i.size > {limit} OR w.cnt >= {most} THEN 1 ELSE w.cnt + 1 END
  FROM walk w JOIN items i ON i.g = w.g AND i.rn = w.rn + 1
)"""
TOKENS = {"group": "source", "id": "doc_id", "size": "sum(length(text) // 4)", "source": "SELECT source, doc_id, text FROM documents", "limit": "4000", "most": "1000000000"}


def _doc_tokens(t: Tables):
    return batching.texts_per_entity(t.documents, "doc_id", "text").select("doc_id", "tokens").join(t.documents.select("doc_id", "source"), "doc_id")


@query(NEXT_FIT.format(**TOKENS, order="doc_id") + " SELECT g AS source, id AS doc_id, CAST(size AS BIGINT) AS tokens, CAST(batch AS INTEGER) AS batch FROM walk")
def token_batches(t):
    return batching.token_batches(_doc_tokens(t), 4000, "source", "doc_id").select("source", "doc_id", "tokens", "batch")


@query(NEXT_FIT.format(**TOKENS, order="doc_id DESC") + " SELECT g AS source, id AS doc_id, CAST(size AS BIGINT) AS tokens, CAST(batch AS INTEGER) AS batch FROM walk")
def token_batches_inverted(t):
    return batching.token_batches(_doc_tokens(t), 4000, "source", "doc_id", inverted=True).select("source", "doc_id", "tokens", "batch")


@query(NEXT_FIT.format(**TOKENS, order="doc_id") + """, b AS (SELECT g, batch, sum(size) AS s FROM walk GROUP BY g, batch)
SELECT g AS source, CAST(count(*) AS BIGINT) AS n_batches, CAST(sum(s) AS BIGINT) AS total, CAST(sum(s) // count(*) AS BIGINT) AS mean, CAST(min(s) AS BIGINT) AS smallest, CAST(max(s) AS BIGINT) AS largest FROM b GROUP BY g""")
def batch_summary(t):
    return batching.batch_summary(batching.token_batches(_doc_tokens(t), 4000, "source", "doc_id"), ["source"])


@query(NEXT_FIT.format(group="hint", id="id", size="count(*)", order="id", limit="60", most="9",
    source="SELECT o_custkey AS id, coalesce(n_name, 'unknown') AS hint FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_name LIKE '%A%' WHERE c_acctbal > 0")
    + " SELECT g AS component_hint, id AS soldier_id, CAST(size AS BIGINT) AS n_records, g || '_batch_' || lpad(CAST(batch AS VARCHAR), CAST(greatest(3, length(CAST(batch AS VARCHAR))) AS INTEGER), '0') AS batch_id FROM walk")
def component_batches(t):
    records = t.orders.select(F.col("o_custkey").alias("soldier_id"))
    mapping = t.entities().where("component_id LIKE '%A%'").select("soldier_id", F.col("component_id").alias("likely_component"))
    only = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("soldier_id"))
    return batching.component_batches(records, mapping, only=only, max_entities=9, max_records=60).select("component_hint", "soldier_id", "n_records", "batch_id")


@query("SELECT c_mktsegment, min(c_custkey) AS c_custkey FROM customer GROUP BY c_mktsegment")
def first_per_group(t):
    return first_per(t.customer, ["c_mktsegment"], F.col("c_custkey")).select("c_mktsegment", "c_custkey")
