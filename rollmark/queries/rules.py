"""Reconciliation, evaluation, costs, artifacts, prompts, the annotator and synthetic rosters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotate, artifacts, batching, evaluate, hierarchy, prompts, reconcile, synth, thresholds
from ..plans import pipelines
from .base import DESIGNATORS, DIMS, ENTITIES, Tables, joined
from .entities import NEXT_FIT

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- two runs over patterns: part names, as rich and as poor parts show them ----


def _runs(t: Tables):
    base = t.part.select(F.col("p_type").alias("component"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("pattern"), F.col("p_brand").alias("means"), F.concat(F.lit("t"), F.col("p_size").cast("string")).alias("tier"), "p_retailprice")
    return base.where("p_retailprice < 915").drop("p_retailprice"), base.where("p_retailprice >= 910").withColumn("pattern", F.upper("pattern")).drop("p_retailprice")


RUNS = """f AS (SELECT p_type AS component, lower(trim(p_name)) AS key, p_name AS pattern, p_brand AS means, 't' || p_size AS tier FROM part WHERE p_retailprice < 915
  QUALIFY row_number() OVER (PARTITION BY p_type, lower(trim(p_name)) ORDER BY p_partkey DESC) = 1),
i AS (SELECT p_type AS component, lower(trim(p_name)) AS key, upper(p_name) AS pattern, p_brand AS means, 't' || p_size AS tier FROM part WHERE p_retailprice >= 910
  QUALIFY row_number() OVER (PARTITION BY p_type, lower(trim(p_name)) ORDER BY p_partkey DESC) = 1),
c AS (SELECT coalesce(f.component, i.component) AS component, coalesce(f.key, i.key) AS key, coalesce(f.pattern, i.pattern) AS pattern, coalesce(f.means, i.means) AS means,
  f.key IS NOT NULL AS in_forward, i.key IS NOT NULL AS in_inverted, CASE WHEN f.key IS NOT NULL AND i.key IS NOT NULL THEN 'robust' ELSE 'order_dependent' END AS status,
  CASE WHEN f.key IS NOT NULL AND i.key IS NOT NULL THEN f.tier ELSE 'tentative' END AS final_confidence FROM f FULL JOIN i ON f.component = i.component AND f.key = i.key)"""


@query(f"WITH {RUNS} SELECT * FROM c")
def dual_run_compare(t):
    return reconcile.compare_runs(*_runs(t), keys=["component"]).drop("forward_confidence", "inverted_confidence")


@query(f"WITH {RUNS} SELECT component, key FROM c WHERE in_forward AND in_inverted")
def robust_patterns(t):
    return reconcile.robust_patterns(reconcile.compare_runs(*_runs(t), keys=["component"])).select("component", "key")


VERDICTS = "v AS (SELECT lower(trim(p_name)) AS key, min(CASE WHEN p_size > 40 THEN 'validated' ELSE 'rejected' END) AS status FROM part WHERE p_type = 'PROMO' GROUP BY 1)"


@query(f"""WITH {RUNS}, {VERDICTS} SELECT component, c.key AS key, coalesce(v.status, c.status) AS status, coalesce(CASE WHEN v.key IS NOT NULL THEN 'strong' END, final_confidence) AS final_confidence
FROM c LEFT JOIN v ON c.key = v.key""")
def verdict_overlay(t):
    verdicts = t.part.where("p_type = 'PROMO'").select(F.col("p_name").alias("pattern"), F.when(F.col("p_size") > 40, "validated").otherwise("rejected").alias("status"), F.lit("strong").alias("confidence"), F.lit("").alias("notes"))
    compared = reconcile.compare_runs(*_runs(t), keys=["component"])
    return reconcile.overlay_verdicts(compared, verdicts).select("component", "key", "status", "final_confidence")


@query(f"""WITH {RUNS}, {VERDICTS}, o AS (SELECT component, c.key, coalesce(v.status, c.status) AS status, coalesce(CASE WHEN v.key IS NOT NULL THEN 'strong' END, final_confidence) AS tier FROM c LEFT JOIN v ON c.key = v.key)
SELECT component, key, tier, true AS final FROM o WHERE status IN ('robust', 'validated') UNION ALL SELECT component, key, 'tentative', false FROM o WHERE status = 'order_dependent'""")
def final_and_flagged(t):
    verdicts = t.part.where("p_type = 'PROMO'").select(F.col("p_name").alias("pattern"), F.when(F.col("p_size") > 40, "validated").otherwise("rejected").alias("status"), F.lit("strong").alias("confidence"), F.lit("").alias("notes"))
    judged = reconcile.overlay_verdicts(reconcile.compare_runs(*_runs(t), keys=["component"]), verdicts)
    final = reconcile.final_patterns(judged).select("component", "key", "tier", F.lit(True).alias("final"))
    return final.unionByName(reconcile.flagged_patterns(judged).select("component", "key", "tier", F.lit(False).alias("final")))


@query("SELECT p_type AS component, p_name AS pattern, p_partkey AS pos FROM part QUALIFY row_number() OVER (PARTITION BY p_type, lower(p_name) ORDER BY p_partkey, p_name) = 1")
def pattern_dedupe(t):
    rows = t.part.select(F.col("p_type").alias("component"), F.col("p_name").alias("pattern"), F.col("p_partkey").alias("pos"))
    return reconcile.dedupe_patterns(rows, ["component"])


@query("""SELECT p_type AS component, lower(trim(p_name)) AS key, min(p_size) AS first_batch, arg_min(p_brand, p_size * 10000000 + p_partkey) AS means FROM part GROUP BY 1, 2""")
def accumulator(t):
    rows = t.part.select(F.col("p_type").alias("component"), F.col("p_size").alias("batch"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("pattern"), F.col("p_brand").alias("means"))
    return reconcile.accumulate(rows, "component", "batch").select("component", "key", "first_batch", "means")


@query("""SELECT p_type AS component, lower(trim(p_name)) AS key, arg_min(p_brand, p_size * 10000000 + p_partkey) = arg_min(p_brand, -p_size * 10000000 + p_partkey) AS same FROM part GROUP BY 1, 2""")
def accumulator_order_check(t):
    rows = t.part.select(F.col("p_type").alias("component"), F.col("p_size").alias("batch"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("pattern"), F.col("p_brand").alias("means"))
    forward = reconcile.accumulate(rows, "component", "batch").select("component", "key", F.col("means").alias("a"))
    inverted = reconcile.accumulate(rows, "component", "batch", inverted=True).select("component", "key", F.col("means").alias("b"))
    return forward.join(inverted, ["component", "key"]).select("component", "key", (F.col("a") == F.col("b")).alias("same"))


def _cases(t: Tables):
    """Hard cases: users with a dear purchase (forward), or with a cheap refund (inverted)."""
    layer = F.when(F.col("event_type") == "click", "complementarity").when(F.col("event_type") == "view", "collision_position").otherwise(F.col("event_type"))
    rows = t.events.select("user_id", layer.alias("layer"), "value", "event_id")
    pick = lambda x: x.groupBy("user_id").agg(F.min_by("layer", "event_id").alias("layer"))
    return pick(rows.where("value > 150")), pick(rows.where("value < 1"))


CASES = """l AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'complementarity' WHEN 'view' THEN 'collision_position' ELSE event_type END AS layer, value, event_id FROM events),
fc AS (SELECT user_id, arg_min(layer, event_id) AS layer FROM l WHERE value > 150 GROUP BY user_id), ic AS (SELECT user_id, arg_min(layer, event_id) AS layer FROM l WHERE value < 1 GROUP BY user_id)"""


@query(f"""WITH {CASES} SELECT coalesce(fc.user_id, ic.user_id) AS user_id, CASE WHEN fc.user_id IS NOT NULL AND ic.user_id IS NOT NULL THEN 'both' WHEN fc.user_id IS NOT NULL THEN 'forward_only' ELSE 'inverted_only' END AS flagged_in,
coalesce(fc.layer, ic.layer) AS layer FROM fc FULL JOIN ic ON fc.user_id = ic.user_id""")
def hard_case_agreement(t):
    return reconcile.all_hard_cases(*_cases(t), "user_id")


@query(f"""WITH {CASES}, u AS (SELECT user_id, layer FROM fc UNION ALL SELECT user_id, layer FROM ic WHERE user_id NOT IN (SELECT user_id FROM fc))
SELECT CAST(count(*) FILTER (layer = 'collision_position') AS BIGINT) AS collision_position, CAST(count(*) FILTER (layer = 'complementarity') AS BIGINT) AS complementarity,
CAST(count(*) FILTER (layer = 'structural_ambiguity') AS BIGINT) AS structural_ambiguity, CAST(count(*) FILTER (layer NOT IN ('collision_position', 'complementarity', 'structural_ambiguity')) AS BIGINT) AS unknown FROM u""")
def hard_cases_by_layer(t):
    return reconcile.hard_cases_by_layer(reconcile.all_hard_cases(*_cases(t), "user_id"))


@query(f"""WITH {CASES} SELECT fc.user_id, array_to_string(list_sort(list(e.event_id))[1:5], ',') AS events FROM fc JOIN events e ON e.user_id = fc.user_id GROUP BY fc.user_id""")
def hard_case_records(t):
    found = reconcile.case_records(_cases(t)[0], t.events.withColumn("text", F.col("event_id").cast("string")), "user_id", "text", "event_id")
    return found.select("user_id", joined("texts").alias("events"))


# ---- artifacts ----


def _patterns(t: Tables):
    return t.part.select(F.col("p_brand").alias("component"), F.col("p_name").alias("pattern"), F.concat_ws(" ", "p_type", F.col("p_size").cast("string")).alias("means"), F.lit("strong").alias("tier")).distinct()


def _rules(t: Tables):
    """Terms that a brand excludes: the first word of the names of its largest parts."""
    return t.part.where("p_size >= 49").select(F.col("p_brand").alias("component"), F.lit("term_presence").alias("rule_type"), F.upper(F.substring_index("p_name", " ", 1)).alias("if_contains"), F.lit(None).cast("int").alias("if_depth")).distinct()


@query("""WITH r AS (SELECT DISTINCT p_brand AS component, lower(split_part(p_name, ' ', 1)) AS term FROM part WHERE p_size >= 49)
SELECT DISTINCT p_brand AS component, p_name AS pattern, p_type || ' ' || p_size AS means FROM part
WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.component = p_brand AND (contains(lower(p_name), term) OR contains(lower(p_type || ' ' || p_size), term)))""")
def contradiction_filter(t):
    return artifacts.drop_contradictions(_patterns(t), _rules(t)).select("component", "pattern", "means")


@query("""SELECT p_brand AS component, p_type AS "group", array_to_string(list_sort(list(DISTINCT p_name)), ',') AS names FROM part GROUP BY p_brand, p_type""")
def grouped_patterns(t):
    rows = t.part.select(F.col("p_brand").alias("component"), "p_type", "p_name")
    found = artifacts.grouped(rows, ["component"], "p_type", "p_name")
    return found.select("component", F.explode("by_group").alias("group", "names")).withColumn("names", joined("names"))


def _artifacts(t: Tables):
    entities = t.entities()
    sized = thresholds.component_thresholds(t.rated()).withColumnRenamed("component_id", "component")
    structure = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("component"), F.col("r_name").alias("branch"), F.lit(2).alias("depth"), F.array(F.lit("nation"), F.lit("segment")).alias("levels")
    )
    patterns = entities.select(F.col("component_id").alias("component"), F.col("segment").alias("pattern"), F.lit("segment").alias("means"), F.lit("moderate").alias("tier")).distinct()
    vocabulary = patterns.select("component", F.lower("pattern").alias("term"), F.lit("strong").alias("strength"))
    rules = patterns.where("pattern = 'BUILDING'").select("component", F.lit("term_presence").alias("rule_type"), F.lit("machin").alias("if_contains"), F.lit(None).cast("int").alias("if_depth"))
    edges = hierarchy.pair_levels(hierarchy.conflict_edges(t.component_designators()))
    diffs = edges.select(F.col("comp_a").alias("component"), F.col("comp_b").alias("rival"), F.lit("hierarchy_only").alias("status"), F.transform("shared", lambda x: F.concat_ws("=", x["level"], x["value"])).alias("rules"))
    return artifacts.assemble(sized, structure, patterns, vocabulary, rules, diffs)


THRESHOLD_SQL = f"""{DESIGNATORS}, counts AS (SELECT component_id, count(DISTINCT soldier_id) AS n FROM entities WHERE balance > 5000 GROUP BY 1),
q AS (SELECT quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS med, quantile_cont(n, 0.75) AS p75 FROM counts),
tiers AS (SELECT component_id AS component, n, CASE WHEN n >= p75 THEN 'well_represented' WHEN n >= med THEN 'adequately_represented' WHEN n >= p25 OR n / med * 100 >= 75 THEN 'under_represented' ELSE 'sparse' END AS tier FROM counts, q)"""


@query(f"""WITH {THRESHOLD_SQL} SELECT component, tier, CAST(n AS BIGINT) AS sample_size, r_name AS branch,
CAST(CASE WHEN tier = 'sparse' THEN NULL ELSE (SELECT count(DISTINCT segment) FROM entities e WHERE e.component_id = component AND NOT (contains(lower(segment), 'machin') AND EXISTS (SELECT 1 FROM entities x WHERE x.component_id = e.component_id AND x.segment = 'BUILDING'))) END AS BIGINT) AS n_patterns,
CAST(coalesce((SELECT count(DISTINCT comp_b) FROM edges WHERE comp_a = component), 0) AS BIGINT) AS n_rivals, CAST(0 AS BIGINT) AS n_errors
FROM tiers JOIN nation ON n_name = component JOIN region ON n_regionkey = r_regionkey""")
def resolver_artifact(t):
    found = artifacts.validation_errors(_artifacts(t))
    j = lambda path, kind: F.try_variant_get(F.try_parse_json("artifact"), path, kind)
    parsed = F.from_json("artifact", "struct<patterns:struct<entries:array<struct<pattern:string>>>,differentiators:struct<rivals:array<struct<rival:string>>>>")
    return found.select(
        "component", j("$.meta.tier", "string").alias("tier"), j("$.meta.sample_size", "bigint").alias("sample_size"), j("$.structure.branch", "string").alias("branch"),
        F.size(parsed["patterns"]["entries"]).cast("long").alias("n_patterns"), F.coalesce(F.size(parsed["differentiators"]["rivals"]), F.lit(0)).cast("long").alias("n_rivals"), F.size("errors").cast("long").alias("n_errors"),
    ).withColumn("n_patterns", F.when(F.col("tier") != "sparse", F.col("n_patterns")))


# ---- evaluation: nations as companies of a region; a prediction is the customer's most frequent order status region ----


def _truth(t: Tables):
    return t.entities().select("soldier_id", "component_id", F.col("branch").alias("division"), F.col("component_id").alias("regiment"), F.col("segment").alias("battalion"))


def _predictions(t: Tables):
    """From a customer's first order: its total says which levels the prediction gets right."""
    first = t.orders.groupBy("o_custkey").agg(F.min_by(F.struct("o_totalprice", "o_orderpriority", "o_orderstatus"), "o_orderkey").alias("o"))
    rows = first.join(t.entities(), F.col("o_custkey") == F.col("soldier_id"))
    price = F.col("o.o_totalprice")
    confidence = F.when(F.col("o.o_orderpriority").startswith("1"), "robust").when(F.col("o.o_orderpriority").startswith("2"), "strong").when(F.col("o.o_orderpriority").startswith("3"), "Moderate").otherwise("guess")
    return rows.select(
        "soldier_id",
        F.when(price > 50000, F.lower("branch")).alias("division"),
        F.when(price > 150000, F.col("component_id")).otherwise("nowhere").alias("regiment"),
        F.when((price > 250000) | (price < 100000), F.col("segment")).alias("battalion"),
        confidence.alias("confidence"),
    )


EVAL = f"""{ENTITIES}, first AS (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS price, arg_min(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY o_custkey),
rows_ AS (SELECT e.soldier_id, component_id, f.o_custkey IS NULL AS err,
  CASE WHEN substring(priority, 1, 1) = '1' THEN 'robust' WHEN substring(priority, 1, 1) = '2' THEN 'strong' WHEN substring(priority, 1, 1) = '3' THEN 'moderate' ELSE 'tentative' END AS confidence,
  coalesce(price > 50000, false) AS d, coalesce(price > 150000, false) AS r, coalesce(price > 250000, false) AS b FROM entities e LEFT JOIN first f ON f.o_custkey = e.soldier_id)"""
_COUNTS = """CAST(count(*) AS BIGINT) AS n_predictions, CAST(count(*) FILTER (err) AS BIGINT) AS n_errors, CAST(count(*) FILTER (d) AS BIGINT) AS division_correct, CAST(count(*) FILTER (r) AS BIGINT) AS regiment_correct,
CAST(count(*) FILTER (b) AS BIGINT) AS battalion_correct, round(coalesce(count(*) FILTER (b) / nullif(count(*) FILTER (NOT err), 0), 0), 6) AS battalion_accuracy, round(count(*) FILTER (err) / count(*), 6) AS error_rate"""
_LEVELS = ("division", "regiment", "battalion")


@query(f"""WITH {EVAL} SELECT 'overall' AS scope, 'all' AS name, {_COUNTS} FROM rows_ UNION ALL SELECT 'component', component_id, {_COUNTS} FROM rows_ GROUP BY component_id
UNION ALL SELECT 'confidence', confidence, {_COUNTS} FROM rows_ GROUP BY confidence""")
def eval_metrics(t):
    predictions = evaluate.parse_assignments(_truth(t), _predictions(t), _LEVELS)
    found = evaluate.metrics(predictions, _truth(t), _LEVELS)
    return found.select("scope", "name", "n_predictions", "n_errors", "division_correct", "regiment_correct", "battalion_correct", "battalion_accuracy", "error_rate")


@query(f"""WITH {EVAL}, c(confidence) AS (VALUES ('robust'), ('strong'), ('moderate'), ('tentative'))
SELECT c.confidence, CAST(count(r.soldier_id) AS BIGINT) AS total, CAST(count(*) FILTER (b) AS BIGINT) AS correct, round(coalesce(count(*) FILTER (b) / nullif(count(r.soldier_id), 0), 0), 6) AS accuracy
FROM c LEFT JOIN (SELECT * FROM rows_ WHERE NOT err) r ON r.confidence = c.confidence GROUP BY c.confidence""")
def confidence_calibration(t):
    return evaluate.calibration(evaluate.parse_assignments(_truth(t), _predictions(t), _LEVELS), _truth(t), _LEVELS)


@query("SELECT c_custkey AS soldier_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_predictions(t):
    return evaluate.missing_predictions(_predictions(t), _truth(t))


@query(f"WITH {ENTITIES} SELECT component_id, CAST(count(DISTINCT soldier_id) AS BIGINT) AS n_entities FROM entities GROUP BY component_id ORDER BY n_entities DESC, component_id LIMIT 5")
def largest_components(t):
    return evaluate.largest_components(_truth(t))


@query("""SELECT c_mktsegment, o_orderpriority, CAST(n AS BIGINT) AS n FROM (SELECT c_mktsegment, o_orderpriority, count(*) AS n, min(o_orderkey) AS f FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, f) = 1""")
def majority_home_unit(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return evaluate.majority(rows, ["c_mktsegment"], "o_orderpriority", "o_orderkey")


TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15, "it": 0.0}
SHARES = f"""t(value, target) AS (VALUES {", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in TARGETS.items())}), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
s AS (SELECT value, target, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM documents), 6) AS share FROM t LEFT JOIN n ON lang = value),
report AS (SELECT value, CAST(n AS BIGINT) AS n, share, target, CASE WHEN share - target > 0.05 THEN 'over' WHEN share - target < -0.05 THEN 'under' ELSE 'within' END AS state FROM s)"""


@query(f"WITH {SHARES} SELECT * FROM report")
def distribution_check(t):
    return evaluate.distribution(t.documents, "lang", TARGETS)


@query(f"WITH {SHARES} SELECT doc_id, lang FROM documents JOIN report ON value = lang WHERE state = 'over' QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= n // 2")
def rebalance_candidates(t):
    return evaluate.adjustment_candidates(t.documents, "lang", evaluate.distribution(t.documents, "lang", TARGETS), "doc_id")


PRICES = (("view", 1.25, 10.0), ("click", 0.1, 0.4), ("purchase", 3.0, 15.0))


@query(f"""WITH p(model, ip, op) AS (VALUES {", ".join(str(p) for p in PRICES)}) SELECT event_type AS model, CAST(count(*) AS BIGINT) AS n_calls, CAST(sum(event_id) AS BIGINT) AS input_tokens, CAST(sum(user_id) AS BIGINT) AS output_tokens,
round(CAST(sum(event_id) / 1e6 * coalesce(any_value(ip), 0) + sum(user_id) / 1e6 * coalesce(any_value(op), 0) AS DOUBLE), 4) AS cost_usd FROM events LEFT JOIN p ON model = event_type GROUP BY event_type""")
def cost_rollup(t):
    prices = t.spark.createDataFrame(list(PRICES), "model string, input_price double, output_price double")
    calls = t.events.select(F.col("event_type").alias("model"), F.col("event_id").alias("input_tokens"), F.col("user_id").alias("output_tokens"))
    return evaluate.cost(calls, prices, ["model"]).withColumn("cost_usd", F.round("cost_usd", 4))


# ---- prompts, annotator, generators ----


def _batches(t: Tables):
    records = t.conversations.select(F.col("conv_id").alias("soldier_id"), "turn", "text")
    mapping = records.select("soldier_id", F.when(F.col("soldier_id") % 3 > 0, F.concat(F.lit("c"), F.col("soldier_id") % 3)).alias("likely_component")).distinct()
    packed = batching.component_batches(records, mapping, max_entities=5, max_records=30)
    texts = records.join(packed.select("soldier_id", "batch_id", "component_hint"), "soldier_id").groupBy("batch_id", "component_hint", "soldier_id")
    entity = texts.agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    grouped = entity.groupBy("batch_id", "component_hint").agg(F.array_sort(F.collect_list(F.struct(F.col("soldier_id").cast("string").alias("id"), "texts"))).alias("entities"))
    none = F.array().cast("array<string>")
    patterns = F.array(F.struct(F.lit("x").alias("pattern"), F.lit("y").alias("means"), F.lit(None).cast("string").alias("tier")))
    return grouped.withColumn("prompt", prompts.consolidation_prompt(F.col("component_hint"), F.lit("a / b"), patterns, none, none, F.col("entities")))


PROMPTS = NEXT_FIT.format(
    group="hint", id="id", size="count(*)", order="id", limit="30", most="5",
    source="SELECT conv_id AS id, CASE WHEN conv_id % 3 > 0 THEN 'c' || (conv_id % 3) ELSE 'unknown' END AS hint FROM conversations",
) + r""", placed AS (
  SELECT id, g AS component_hint, g || '_batch_' || lpad(CAST(batch AS VARCHAR), CAST(greatest(3, length(CAST(batch AS VARCHAR))) AS INTEGER), '0') AS batch_id FROM walk
), entity AS (
  SELECT batch_id, component_hint, CAST(id AS VARCHAR) AS id, (list('  - ' || text ORDER BY turn, text))[1:5] AS texts FROM conversations JOIN placed ON conv_id = id GROUP BY batch_id, component_hint, id
), prompts AS (
  SELECT batch_id, component_hint, concat_ws(chr(10) || chr(10), 'Assign ' || count(*) || ' entities to units of ' || component_hint || ' from their records.',
         'STRUCTURE:' || chr(10) || 'a / b', 'PATTERNS:' || chr(10) || '  - ''x'' [tentative]: y',
         'RECORDS:' || chr(10) || string_agg('[' || id || ']' || chr(10) || array_to_string(texts, chr(10)), chr(10) ORDER BY id),
         'Answer with JSON: {"assignments": [{"soldier_id", "levels", "confidence": "robust|strong|moderate|tentative", "reasoning"}]}') AS prompt
  FROM entity GROUP BY batch_id, component_hint
)"""  # fmt: skip


@query(PROMPTS + " SELECT batch_id, component_hint, prompt FROM prompts")
def prompt_text(t):
    return _batches(t).select("batch_id", "component_hint", "prompt")


@query(PROMPTS + r""", blocks AS (
  SELECT batch_id, component_hint, regexp_extract_all(prompt, '(?m)^\[([^\n]+?)\]\n((?:  - [^\n]*\n?)+)', 1) AS ids, regexp_extract_all(prompt, '(?m)^\[([^\n]+?)\]\n((?:  - [^\n]*\n?)+)', 2) AS lines FROM prompts
), answers AS (
  SELECT batch_id, list_transform(list_zip(ids, list_transform(lines, lambda x: regexp_extract(x, '\p{Nd}+'))),
         lambda x: '{"soldier_id": "' || x[1] || '", "regiment": ' || CASE WHEN x[2] = '' THEN 'null, "confidence": "tentative"}' ELSE '"' || x[2] || '", "confidence": "moderate"}' END) AS found FROM blocks
) SELECT batch_id, component_hint, CASE WHEN component_hint = 'c1' THEN '{"assignments": [' || array_to_string(found, ', ') || ']}' END AS answer, CAST(NULL AS VARCHAR) AS error,
CASE component_hint WHEN 'unknown' THEN 'no_hint' WHEN 'c1' THEN NULL ELSE 'no_resolver' END AS fallback FROM blocks JOIN answers USING (batch_id)""")
def annotate_mock(t):
    known = t.spark.createDataFrame([("c1",)], "component_hint string")
    return annotate.consolidate(_batches(t), annotate.mock_annotator, known).select("batch_id", "component_hint", "answer", "error", "fallback")


@query()
def generated_artifacts(t):
    entities = t.entities()
    validation = entities.select(F.col("component_id").alias("component"), "soldier_id", F.lit("segment").alias("level"), F.col("segment").alias("value"))
    raw = t.orders.select(F.col("o_custkey").alias("soldier_id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus", F.initcap(F.lit("shipment"))).alias("raw_text"))
    structure = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("component"), F.col("r_name").alias("branch"), F.lit(2).alias("depth"), F.array(F.lit("nation"), F.lit("segment")).alias("levels")
    )
    rules = structure.select("component", F.lit("term_presence").alias("rule_type"), F.lit("zzz").alias("if_contains"), F.lit(None).cast("int").alias("if_depth"))
    return pipelines.generate_artifacts(t.spark, validation, raw, structure, t.component_designators(), rules, samples=5)


@query(f"""WITH {ENTITIES}, s AS (
  SELECT branch, soldier_id, count(*) OVER (PARTITION BY branch) AS n, row_number() OVER (PARTITION BY branch ORDER BY md5('42:' || soldier_id), soldier_id) AS nth FROM entities
), test AS (SELECT soldier_id, branch FROM s WHERE nth <= CASE WHEN n < 2 THEN 0 ELSE greatest(1, least(round_even(round(n * (1 - 0.7), 9), 0), n - 1)) END
), texts AS (SELECT o_custkey AS soldier_id, list_sort(list(concat_ws(' ', o_orderpriority, o_orderstatus))) AS found FROM orders GROUP BY o_custkey
), predicted AS (
  SELECT branch, regexp_extract(array_to_string(found[1:5], ' '), '[0-9]+') AS regiment FROM test JOIN texts USING (soldier_id)
), judged AS (SELECT branch, CASE WHEN regiment = '' THEN 'tentative' ELSE 'moderate' END AS confidence, regiment = '1' AS correct FROM predicted
), counted AS (
  SELECT CASE GROUPING(branch, confidence) WHEN 3 THEN 'overall' WHEN 1 THEN 'component' ELSE 'confidence' END AS scope, CASE GROUPING(branch, confidence) WHEN 3 THEN 'all' WHEN 1 THEN branch ELSE confidence END AS name,
         CAST(count(*) AS BIGINT) AS n_predictions, CAST(count(*) FILTER (correct) AS BIGINT) AS regiment_correct
  FROM judged GROUP BY GROUPING SETS ((), (branch), (confidence))
), totals AS (
  SELECT 'component' AS scope, branch AS name, CAST(count(DISTINCT soldier_id) AS BIGINT) AS total_entities FROM entities GROUP BY branch UNION ALL SELECT 'overall', 'all', CAST(count(DISTINCT soldier_id) AS BIGINT) FROM entities
) SELECT scope, name, n_predictions, CAST(0 AS BIGINT) AS n_errors, regiment_correct, total_entities, round(CAST(regiment_correct AS DOUBLE) / n_predictions, 6) AS regiment_accuracy, CAST(0 AS DOUBLE) AS error_rate,
round(coalesce(CAST(n_predictions AS DOUBLE) / total_entities, 0), 6) AS coverage FROM counted LEFT JOIN totals USING (scope, name)""")
def strategy_evaluation(t):
    records = t.orders.select(F.col("o_custkey").alias("soldier_id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("raw_text"))
    entities = t.entities()
    mapping = entities.select("soldier_id", F.col("branch").alias("likely_component"))
    truth = entities.select("soldier_id", F.col("branch").alias("component_id"), F.lit("1").alias("regiment"))
    known = t.region.select(F.col("r_name").alias("component_hint"))
    return pipelines.evaluate_strategy(records, mapping, truth, known)


@query()
def synthetic_records(t):
    terms = t.region.select(F.col("r_name").alias("branch"), F.lower("r_name").alias("term"))
    return pipelines.synthetic_roster(t.spark, t.dims(), terms, 2000, 200)["records"]


def _unit(purpose: str, *keys: str) -> str:
    """SQL of a reproducible number in [0, 1) for each key, as the generators draw it with seed 42."""
    key = " || ':' || ".join([f"'42:{purpose}'", *(f"CAST({k} AS VARCHAR)" for k in keys)])
    return f"(CAST('0x' || substring(md5({key}), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE))"


def _pick(draw: str, options: str) -> str:
    """SQL of one element of a list, each as likely."""
    return f"({options})[least(CAST(floor({draw} * len({options})) AS BIGINT) + 1, len({options}))]"


def _weighted(draw: str, options) -> str:
    """SQL of the option whose cumulative weight reaches the draw."""
    out, at = [], 0.0
    for value, weight in options:
        at += weight
        out.append(f"WHEN {draw} < CAST({at!r} AS DOUBLE) THEN {value!r}")
    return f"CASE {' '.join(out)} ELSE {options[-1][0]!r} END"


def _move(k: int) -> str:
    """SQL of the k-th state of the entities that have one, level by level, from the state before."""
    move = _unit("move", "m.soldier_id", str(k), "o.level")
    return f"""m{k} AS (
  SELECT soldier_id, n_states, transfer, old_branch,
         CASE WHEN transfer = 'cross_branch' AND len(others) > 0 THEN {_pick(_unit("cross", "soldier_id", str(k)), "others")} ELSE old_branch END AS branch
  FROM (SELECT DISTINCT soldier_id, n_states, branch AS old_branch, list_filter(names, lambda x: x <> branch) AS others, {_weighted(_unit("scope", "soldier_id", str(k)), synth.TRANSFERS)} AS transfer
        FROM s{k - 1}, organisation WHERE n_states >= {k})
), o{k} AS (
  SELECT m.*, o.level, o.nth, o.depth, o.options, b.value AS before, list_filter(o.options, lambda x: x <> coalesce(b.value, '')) AS other, {move} AS draw,
         CASE WHEN m.branch <> m.old_branch THEN 0 WHEN transfer = 'within_level3' AND o.depth > 3 THEN 3 WHEN transfer IN ('within_level3', 'within_level2') THEN 2 ELSE 1 END AS keep
  FROM m{k} m JOIN levels o ON o.branch = m.branch LEFT JOIN (SELECT soldier_id, level, value FROM s{k - 1}) b ON b.soldier_id = m.soldier_id AND b.level = o.level
), s{k} AS (
  SELECT soldier_id, n_states, {k} AS state_order, transfer, branch, level, nth,
         CASE WHEN nth < keep THEN before WHEN len(other) > 0 THEN {_pick("draw", "other")} ELSE {_pick("draw", "options")} END AS value FROM o{k}
)"""


STATES = f"""{DIMS}, levels AS (
  SELECT branch, level, row_number() OVER (PARTITION BY branch ORDER BY min(level_idx)) - 1 AS nth, count(*) OVER (PARTITION BY branch) AS depth, list_sort(list(DISTINCT value)) AS options
  FROM dims GROUP BY branch, level
), organisation AS (SELECT list_sort(list(DISTINCT branch)) AS names FROM dims), people AS (
  SELECT 'S' || lpad(CAST(id AS VARCHAR), 6, '0') AS soldier_id, {_weighted(_unit("states", "id"), synth.STATE_COUNTS)} AS n_states FROM range(2000) r(id)
), posted AS (SELECT soldier_id, n_states, {_pick(_unit("branch", "soldier_id"), "names")} AS branch FROM people, organisation
), s1 AS (
  SELECT soldier_id, n_states, 1 AS state_order, CAST(NULL AS VARCHAR) AS transfer, branch, level, nth, {_pick(_unit("post", "soldier_id", "0", "level"), "options")} AS value
  FROM posted JOIN levels USING (branch)
), {_move(2)}, {_move(3)}, states AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)"""


@query(f"""WITH {STATES} SELECT soldier_id || '-' || state_order AS state_id, soldier_id, CAST(state_order AS INTEGER) AS state_order, transfer, branch,
array_to_string(list(coalesce(value, '') ORDER BY nth), '/') AS post_path FROM states GROUP BY soldier_id, state_order, transfer, branch""")
def synthetic_states(t):
    return synth.states(synth.soldiers(t.spark, 2000), t.dims()).select("state_id", "soldier_id", "state_order", "transfer", "branch", "post_path")


SITUATIONS = "['march', 'camp', 'siege', 'parade']"


@query(f"""WITH RECURSIVE drawn AS (
  SELECT c_mktsegment AS g, c_custkey AS id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn, {_unit("reuse", "c_custkey")} AS reuse, {_unit("which", "c_custkey")} AS which FROM customer
), ready AS (SELECT *, {_pick("which", SITUATIONS)} AS fresh FROM drawn), walk AS (
  SELECT g, id, rn, fresh AS situation, [fresh] AS used, [1] AS times FROM ready WHERE rn = 1
  UNION ALL SELECT g, id, rn, chosen, CASE WHEN list_contains(used, chosen) THEN used ELSE list_append(used, chosen) END,
    CASE WHEN list_contains(used, chosen) THEN list_transform(times, lambda n, i: CASE WHEN used[i] = chosen THEN n + 1 ELSE n END) ELSE list_append(times, 1) END
  FROM (
    SELECT g, id, rn, used, times, CASE WHEN reuse < 0.7 THEN used[CASE WHEN which * (a + b + c + d) <= a THEN 1 WHEN which * (a + b + c + d) <= a + b THEN 2 WHEN which * (a + b + c + d) <= a + b + c THEN 3 ELSE len(used) END] ELSE fresh END AS chosen
    FROM (SELECT r.*, used, times, sqrt(times[1]) AS a, coalesce(sqrt(times[2]), 0) AS b, coalesce(sqrt(times[3]), 0) AS c, coalesce(sqrt(times[4]), 0) AS d FROM walk w JOIN ready r ON r.g = w.g AND r.rn = w.rn + 1)
  )
) SELECT g AS c_mktsegment, id AS c_custkey, situation FROM walk""")
def sequential_situations(t):
    return synth.sequential_situations(t.customer.select("c_mktsegment", "c_custkey"), ["march", "camp", "siege", "parade"], "c_mktsegment", "c_custkey")


@query("""WITH v AS (SELECT lower(p_type) || '_' || split_part(p_name, ' ', 2) AS name, p_name AS term FROM part), p(pattern) AS (VALUES ('promo_*'), ('small_bolt'), ('none_*'))
SELECT pattern, coalesce(array_to_string(list_sort(list(DISTINCT term) FILTER (term IS NOT NULL)), ','), '') AS terms FROM p LEFT JOIN v ON CASE WHEN pattern LIKE '%*' THEN starts_with(name, substring(pattern, 1, length(pattern) - 1)) ELSE name = pattern END GROUP BY pattern""")
def resolved_vocabulary(t):
    name = F.concat_ws("_", F.lower("p_type"), F.split_part("p_name", F.lit(" "), F.lit(2)))
    vocabulary = t.part.groupBy(name.alias("name")).agg(F.collect_set("p_name").alias("terms"))
    patterns = t.spark.createDataFrame([("promo_*",), ("small_bolt",), ("none_*",)], "pattern string")
    return synth.resolve_terms(vocabulary, patterns).withColumn("terms", joined("terms"))


def _chance(name: str) -> str:
    return f"least(1, greatest(0, {name} + (2 * {_unit(name, 'id')} - 1) * CAST(0.1 AS DOUBLE))) AS {name}"


@query(f"""WITH kinds(archetype, omits, mistypes, abbreviates) AS (VALUES {", ".join(f"('{k}', " + ", ".join(f"CAST({x} AS DOUBLE)" for x in v) + ")" for k, v in sorted(synth.ARCHETYPES.items()))}),
drawn AS (SELECT id, {_pick(_unit("archetype", "id"), str(sorted(synth.ARCHETYPES)))} AS archetype FROM range(500) r(id))
SELECT 'K' || lpad(CAST(id AS VARCHAR), 4, '0') AS clerk_id, archetype, {", ".join(map(_chance, ("omits", "mistypes", "abbreviates")))} FROM drawn JOIN kinds USING (archetype)""")
def synthetic_clerks(t):
    return synth.clerks(t.spark, 500)


@query()
def roster_stats(t):
    terms = t.region.select(F.col("r_name").alias("branch"), F.lower("r_name").alias("term"))
    made = pipelines.synthetic_roster(t.spark, t.dims(), terms, 2000, 200)
    return synth.roster_stats(made["sources"], made["records"])
