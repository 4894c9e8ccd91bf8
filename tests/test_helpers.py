"""Readers, writers and helpers that no registered query calls."""

import pytest
from pyspark.sql import functions as F

from rollmark.functions import relational
from rollmark.operators import artifacts, difficulty, glossary, prompts, reconcile, sampling, synth
from rollmark.sources import tables


def test_artifacts_by_folder(spark, tmp_path):
    rows = [("port", '{"meta": {"tier": "sparse"}}'), ("railway", '{"meta": {}}')]
    folder = tables.write_artifacts(spark.createDataFrame(rows, "component string, artifact string"), f"{tmp_path}/a")
    assert sorted((r["component"], r["artifact"]) for r in tables.read_artifacts(spark, folder).collect()) == rows
    assert [r[0] for r in tables.list_artifacts(spark, folder).collect()] == ["port", "railway"]


def test_metadata_is_what_is_beyond_the_core(spark, tmp_path):
    frame = spark.createDataFrame([(1, "s", "t", "x")], "soldier_id long, source_id string, raw_text string, `a.b` string")
    core = ("soldier_id", "source_id", "raw_text")
    path = tables.write_metadata(frame, None, core, f"{tmp_path}/m")
    assert spark.read.parquet(path).columns == ["source_id", "soldier_id", "a.b"]
    assert tables.write_metadata(frame.drop("`a.b`").select(*core), None, core, f"{tmp_path}/n") is None
    own = spark.createDataFrame([(7,)], "z long")
    assert spark.read.parquet(tables.write_metadata(frame, own, core, f"{tmp_path}/o")).collect() == own.collect()


def test_hand_made_hierarchy_parts(spark):
    found = {
        "branches": {},
        "collision_index": {"numbers": {"7": ["port.crane", "railway.track"]}, "names": {"North": ["port.quay"]}, "other": {"x": ["y.z"]}},
        "structural_signals": {"branch_unique_terms": {"ballast": "railway"}},
    }
    rows = sorted(map(tuple, tables.cross_level_index(spark, found).collect()))
    assert rows == [("names", "North", "port", "quay"), ("numbers", "7", "port", "crane"), ("numbers", "7", "railway", "track")]
    assert [tuple(r) for r in tables.unique_terms(spark, found).collect()] == [("railway", "ballast")]
    assert tables.unique_terms(spark, {}).count() == tables.cross_level_index(spark, {}).count() == 0


def test_columns(spark):
    frame = spark.createDataFrame([(1,)], "primary_id long")
    assert relational.normalize_ids(frame).columns == ["soldier_id"]
    assert relational.normalize_ids(relational.normalize_ids(frame)).columns == ["soldier_id"]
    full = relational.ensure_columns(frame, {"primary_id": "string", "x": "int"})
    assert full.dtypes == [("primary_id", "bigint"), ("x", "int")] and full.head()["x"] is None


def test_metadata_joins_raw_records(spark):
    raw = spark.createDataFrame([("a", 1, "t"), ("b", 2, "u")], "source_id string, soldier_id long, raw_text string")
    meta = spark.createDataFrame([("a", 1, "other", 5), ("c", 3, "none", 6)], "source_id string, soldier_id long, raw_text string, page int")
    found = {r["soldier_id"]: r.asDict() for r in difficulty.merge_metadata(raw, meta).collect()}
    assert found[1] == {"source_id": "a", "soldier_id": 1, "raw_text": "t", "raw_text_synthetic": "other", "page": 5}
    assert found[2]["page"] is None and len(found) == 2
    assert difficulty.merge_metadata(raw, meta.select("page")) is raw


def test_validated_tiers_override(spark):
    patterns = spark.createDataFrame([("Quay ", "weak", None), ("Crane", "strong", "run")], "pattern string, tier string, provenance string")
    validated = spark.createDataFrame([("quay", "robust", "checked"), ("else", "robust", "checked")], "pattern string, tier string, provenance string")
    found = {tuple(r) for r in reconcile.overlay_tiers(patterns, validated).select("pattern", "tier", "provenance").collect()}
    assert found == {("Quay ", "robust", "checked"), ("Crane", "strong", "run")}


def test_hard_cases(spark):
    text = 'Well: {"hard_cases": [{"soldier_id": "2", "layer": "complementarity", "reason": "r"}, {"soldier_id": "1"}, {"soldier_id": "3", "layer": "made_up"}]}'
    cases = artifacts.parse_hard_cases(spark.createDataFrame([("c", text), ("d", "no"), ("e", None)], "component string, answer string"), "answer", ["component"])
    assert sorted((r["soldier_id"], r["layer"]) for r in cases.collect()) == [("1", "unknown"), ("2", "complementarity"), ("3", "made_up")]
    layers = {r["layer"]: r["ids"] for r in reconcile.ids_by_layer(cases).collect()}
    assert layers == {"complementarity": ["2"], "unknown": ["1", "3"]}


def test_orders(spark):
    frame = spark.createDataFrame([(i,) for i in (2, 1, 3)], "id long")
    position = spark.createDataFrame([(3, 0), (1, 1)], "id long, pos int")
    ids = lambda order, p=None: [r["id"] for r in sampling.custom_order(frame, order, "id", p).collect()]
    assert ids("forward") == [1, 2, 3] and ids("inverted") == [3, 2, 1] and ids("explicit", position) == [3, 1, 2]
    with pytest.raises(ValueError):
        ids("explicit")
    terms = spark.createDataFrame([("b", "Role Term"), ("c", "Unit Term"), ("a", "Unit Term"), ("z", "Organization Term")], "full_term string, term_type string")
    assert [r["full_term"] for r in glossary.ordered_terms(terms).collect()] == ["z", "a", "c", "b"]


def test_prompts(spark):
    texts = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    entry = F.array(F.struct(F.lit("Quay").alias("pattern"), F.lit("place").alias("means"), F.lit("strong").alias("tier")))
    row = spark.range(1).select(
        prompts.discovery_prompt(F.lit("port"), F.lit("railway"), texts("t1"), texts(), texts("Crane")).alias("d"),
        prompts.vocabulary_prompt(F.lit("port"), texts("t1", "t2")).alias("v"),
        prompts.reconciliation_prompt(F.lit("port"), entry, entry, texts("case")).alias("r"),
    ).head()
    assert row["d"].split("\n\n") == ["Find text patterns that tell port from railway.", "RECORDS A:\n  - t1", "KNOWN PATTERNS:\n  - Crane", prompts.DISCOVERY_TAIL]
    assert "RECORDS:\n  - t1\n  - t2" in row["v"] and "INVERTED:\n  - 'Quay' [strong]: place" in row["r"] and "HARD CASES:\n  - case" in row["r"]
    assert artifacts.schema_suffix("a int").strip().endswith("a int")


def test_terms_by_chance(spark):
    rows = spark.range(2000).select(synth.inject_terms(F.lit("text"), F.array(F.lit("quay"), F.lit("crane")), 0.3, 42, "terms", F.col("id")).alias("t")).collect()
    found = [r["t"] for r in rows]
    assert set(found) == {"text", "text quay", "text  quay", "text crane", "text  crane"}
    assert 0.25 < sum(t != "text" for t in found) / 2000 < 0.35
    never = spark.range(5).select(synth.inject_terms(F.lit("text"), F.array().cast("array<string>"), 1.0, 42, "terms", F.col("id")).alias("t"))
    assert {r["t"] for r in never.collect()} == {"text"}
