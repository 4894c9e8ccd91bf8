"""Discriminators, rules, JSON round trips and readers."""

import json

import pytest

from rollmark.operators import artifacts, hierarchy
from rollmark.operators.glossary import GlossaryForms
from rollmark.sources import tables

WATERS = {
    "branches": {
        "port": {"depth": 3, "levels": ["quay", "crane", "shift"], "valid_designators": {"quay": ["North", "South", "Long"], "crane": [7, 8], "shift": ["D", "E"]}},
        "railway": {"depth": 4, "levels": ["quay", "yard", "track", "crew"], "valid_designators": {"quay": ["North", "West"], "yard": ["Amber", "Jade"], "track": [7, 9, 11], "crew": ["E", "P"]}},
        "airfield": {"depth": 2, "levels": ["apron", "stand"], "valid_designators": {"apron": [7], "stand": ["003", "Z"]}},
    },
    "components": ["port/North/7/D", "port/South/8/D", "railway/North/Amber/7/P"],
}


@pytest.fixture(scope="module")
def dims(spark):
    return tables.hierarchy_rows(spark, WATERS).cache()


def test_level_names(dims):
    found = {r["level"]: r for r in hierarchy.level_discriminators(dims).collect()}
    assert found["yard"]["unique_to"] == "railway"
    assert found["quay"]["unique_to"] is None and found["quay"]["appears_in"] == ["port", "railway"]


def test_designators(dims):
    found = {r["value"]: r for r in hierarchy.designator_discriminators(dims).collect()}
    assert found["West"]["unique_to_branch"] == "railway" and found["West"]["type"] == "word"
    assert found["7"]["type"] == "numeric" and set(found["7"]["valid_in"]) == {"port", "railway", "airfield"}
    assert found["Z"]["type"] == "alpha" and found["E"]["unique_to_branch"] is None
    assert "003" not in found and found["3"]["unique_to_branch"] == "airfield"


def test_collision_index(dims):
    found = {(r["level"], r["value"]): r["members"] for r in hierarchy.collision_index(dims).collect()}
    assert found == {("quay", "North"): ["port.quay", "railway.quay"]}


def test_rules(dims):
    rules = [r.asDict() for r in hierarchy.exclusion_rules(dims).collect()]
    assert {r["depth"] for r in rules if r["rule_type"] == "depth_mismatch" and r["excludes_branch"] == "airfield"} == {3, 4}
    terms = [r for r in rules if r["rule_type"] == "term_presence" and r["token"] == "yard"]
    assert {r["excludes_branch"] for r in terms} == {"port", "airfield"}
    assert all(r["strength"] == "definitive" for r in rules)


def test_component_collisions(spark, dims):
    found = hierarchy.component_collisions(hierarchy.component_designators(tables.component_rows(spark, WATERS), dims))
    rows = {(r["level"], r["value"]): r["members"] for r in found.collect()}
    assert rows == {("quay", "North"): ["port/North/7/D", "railway/North/Amber/7/P"], ("shift", "D"): ["port/North/7/D", "port/South/8/D"]}


def test_discriminators_round_trip(dims):
    index = hierarchy.collision_index(dims)
    text = tables.discriminators_json(hierarchy.level_discriminators(dims), hierarchy.designator_discriminators(dims), hierarchy.depth_discriminators(dims), index, hierarchy.exclusion_rules(dims))
    assert set(json.loads(text.head()[0])) == {"level_names", "designators", "depths", "collision_index", "branch_exclusion_rules"}
    back = {(r["level"], r["value"]): r["members"] for r in tables.collision_index_from_json(text).collect()}
    assert back == {(r["level"], r["value"].upper() if not r["value"].isdigit() else r["value"]): r["members"] for r in index.collect()}


@pytest.mark.parametrize("bad", [{}, {"branches": {"x": {"depth": 2}}}, {"branches": {"x": {"levels": ["a"]}}}])
def test_bad_hierarchies(spark, bad):
    with pytest.raises(ValueError):
        tables.hierarchy_rows(spark, bad)


def test_unknown_term_type():
    with pytest.raises(ValueError):
        GlossaryForms().add("x", [], "Colour Term")


def test_split_json_round_trip(spark):
    split = spark.createDataFrame([("c", "1", "train"), ("c", "2", "test"), ("c", "3", "train")], "component_id string, soldier_id string, split string")
    back = tables.split_from_json(tables.split_json(split))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, split.collect()))


def test_tables_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([(1, ["a"], None)], "soldier_id long, xs array<string>, t string")
    tables.write_tables({"x": frame, "y": None}, str(tmp_path))
    assert tables.read_table(spark, f"{tmp_path}/x", ("soldier_id",)).collect() == frame.collect()
    with pytest.raises(ValueError):
        tables.read_table(spark, f"{tmp_path}/x", ("nothing",))
    assert tables.read_optional(spark, f"{tmp_path}/none") is None
    tables.write_table(frame, f"{tmp_path}/csv", "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").head()["xs"] == '["a"]'


def test_artifact_validation(spark):
    good = json.dumps({"meta": {"component_id": "a", "tier": "sparse"}, "structure": {"status": "complete"}, "patterns": {}, "vocabulary": {}, "exclusions": {}, "differentiators": {}})
    rows = spark.createDataFrame([("good", good), ("bad", '{"meta": {}}'), ("broken", "no json")], "component string, artifact string")
    errors = {r["component"]: r["errors"] for r in artifacts.validation_errors(rows).collect()}
    assert errors["good"] == []
    assert "meta.tier is required" in errors["bad"] and "Missing required section: patterns" in errors["bad"]
    assert len(errors["broken"]) == 6
