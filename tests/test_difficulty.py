"""Cases of difficulty worked out by hand: a port and a railway that share their quays."""

import pytest
from pyspark.sql import functions as F

from rollmark.operators import difficulty, hierarchy
from rollmark.sources.tables import hierarchy_rows

# The quay North is in both; crane 7 and track 7 have one number.
ORGANISATION = {
    "branches": {
        "port": {"depth": 3, "levels": ["quay", "crane", "shift"], "valid_designators": {"quay": ["North", "South"], "crane": [7, 8], "shift": ["D", "E"]}},
        "railway": {"depth": 4, "levels": ["quay", "yard", "track", "crew"], "valid_designators": {"quay": ["North", "South"], "yard": ["Amber", "Jade"], "track": [7, 9], "crew": ["P", "Q"]}},
    }
}
SCHEMA = "soldier_id string, `Unit_Term_Digit_Term:Pair` array<string>, `Unit_Term_Alpha_Term:Pair` array<string>, Unchar_Alpha array<string>, Unchar_Digits array<string>, Unit_Terms array<string>, Org_Terms array<string>"
ROWS = [
    ("crane alone", ["Crane:8"], [], [], [], [], []),
    ("quay and a word for cranes", [], [], ["North"], [], ["CRANE"], []),
    ("all of the port", ["Crane:8"], ["Shift:E"], ["North"], [], [], []),
    ("quay and crane", ["Crane:7"], [], ["North"], [], [], []),
    ("quay alone", [], [], ["North"], [], [], []),
    ("quay and a number of both", [], [], ["North"], ["7"], [], []),
    ("quay and a yard", [], [], ["North", "Jade"], [], [], []),
    ("nothing", [], [], [], [], [], []),
    ("nulls", None, None, None, None, None, None),
]
#: collision, score, remaining branches, tier. Port: a level counts a third; railway: a fourth. A pair
#: counts 1, a value valid at one level of the branch 0.75.
WANTED = {
    "crane alone": (False, 1 / 3, ["port", "railway"], "easy"),
    "quay and a word for cranes": (True, 0.75 / 3, ["port"], "moderate"),
    "all of the port": (True, 2.75 / 3, ["port", "railway"], "moderate"),
    "quay and crane": (True, 1.75 / 3, ["port", "railway"], "hard"),
    "quay alone": (True, 0.75 / 3, ["port", "railway"], "extreme"),
    "quay and a number of both": (True, 1.5 / 3, ["port", "railway"], "hard"),
    "quay and a yard": (True, 1.5 / 4, ["railway"], "moderate"),
    "nothing": (True, 0.0, ["port", "railway"], "extreme"),
    "nulls": (True, 0.0, ["port", "railway"], "extreme"),
}


@pytest.fixture(scope="module")
def found(spark):
    dims = hierarchy_rows(spark, ORGANISATION)
    index = hierarchy.collision_index(dims).where("level = 'quay' AND value = 'North'")
    out = difficulty.inferred_difficulty(spark.createDataFrame(ROWS, SCHEMA), dims, index, hierarchy.exclusion_rules(dims))
    return {r["soldier_id"]: r for r in out.collect()}


@pytest.mark.parametrize("name", WANTED)
def test_inferred(found, name):
    row, (collision, score, remaining, tier) = found[name], WANTED[name]
    assert row["inferred_collision_position"] is collision
    assert row["inferred_complementarity_score"] == pytest.approx(score)
    assert row["inferred_candidate_branches"] == remaining and row["inferred_structural_resolvability"] == (len(remaining) == 1)
    assert row["inferred_difficulty_tier"] == tier


def test_what_excludes_the_others(found):
    assert found["quay and a word for cranes"]["inferred_eliminating_constraints"] == ["contains term 'crane'"]
    assert found["quay and a yard"]["inferred_eliminating_constraints"] == ["contains designator 'Jade' (only valid in railway)"]
    assert found["quay alone"]["inferred_eliminating_constraints"] == []


@pytest.mark.parametrize(
    ("complete", "zone", "worst", "score", "resolvable", "tier"),
    [
        (True, True, "high", 0.1, False, "moderate"),
        (True, True, "high", 0.1, True, "easy"),
        (True, False, "none", 0.1, False, "easy"),
        (False, False, "none", 0.9, False, "easy"),
        (False, True, "cross_branch", 0.2, False, "extreme"),
        (False, True, "low", 0.4, False, "hard"),
        (False, True, "low", 0.7, False, "moderate"),
    ],
)
def test_ground_truth_tiers(spark, complete, zone, worst, score, resolvable, tier):
    row = spark.range(1).select(difficulty.gt_tier(F.lit(complete), F.lit(zone), F.lit(worst), F.lit(score), F.lit(resolvable)).alias("t")).head()
    assert row["t"] == tier


def test_severities(spark):
    index = spark.createDataFrame([("numbers", "1", "a", "x"), ("numbers", "1", "a", "y"), ("letters", "Q", "a", "x"), ("names", "Z", "b", "x"), ("numbers", "3", "a", "x"), ("numbers", "3", "a", "y"), ("numbers", "3", "a", "z")], "section string, designator string, branch string, level string")
    states = spark.createDataFrame([("s", "low", "a", {"l": "1"}), ("s", "none", "a", {"l": "Q"}), ("s", "cross_branch", "a", {"l": "Z"}), ("s", "medium", "a", {"l": "3"})], "soldier_id string, state_id string, branch string, post_levels map<string,string>")
    for row in difficulty.severity(states, index).collect():
        assert row["gt_collision_severity"] == row["state_id"]
