"""Splits, quotas, batches, runs and evaluation on literal rows."""

import pytest
from pyspark.sql import functions as F

from rollmark.operators import batching, evaluate, reconcile, sampling, synth, thresholds


def pool(spark, rows):
    return spark.createDataFrame([("p", i, t) for i, t in rows], "k string, id string, tier string")


def quota(spark, rows, weights, k):
    out = sampling.quota_sample(pool(spark, rows), ["k"], "id", "tier", weights, k)
    return [r.asDict() for r in out.collect()]


def test_quota_is_dealt_again(spark):
    rows = [("E1", "extreme"), *[(f"H{i}", "hard") for i in range(1, 6)]]
    got = quota(spark, rows, {"extreme": 0.5, "hard": 0.5}, 4)
    assert sorted(r["tier"] for r in got) == ["extreme", "hard", "hard", "hard"]
    assert not any(r["undersampled"] for r in got)


def test_unassigned_fill_up(spark):
    got = quota(spark, [("S1", "extreme"), ("S2", None), ("S3", None), ("S4", None)], {"extreme": 1.0}, 3)
    assert len(got) == 3 and "S1" in {r["id"] for r in got}


def test_small_pools_are_taken_whole(spark):
    got = quota(spark, [("a", "hard"), ("b", None)], {"hard": 1.0}, 2)
    assert len(got) == 2 and all(r["undersampled"] for r in got)


def test_component_split(spark):
    frame = spark.createDataFrame([("C1", f"S{i}") for i in range(3)] + [("C2", f"T{i}") for i in range(3)] + [("C3", "U")], "component_id string, soldier_id string")
    split = sampling.component_split(frame, train_ratio=0.5)
    rows = split.collect()
    assert len(rows) == 7 and sampling.leakage(split).count() == 0
    for c in ("C1", "C2"):
        assert {r["split"] for r in rows if r["component_id"] == c} == {"train", "test"}
    assert [r["split"] for r in rows if r["component_id"] == "C3"] == ["train"]


def test_entities_stay_on_one_side(spark):
    frame = spark.createDataFrame([("c", f"S{i // 2}", f"r{i % 2}") for i in range(80)], "component_id string, soldier_id string, regiment string")
    assert sampling.leakage(sampling.stratified_split(frame)).count() == 0


def test_next_fit(spark):
    items = spark.createDataFrame([("a", i, s) for i, s in enumerate([3, 3, 5, 12, 1, 9])] + [(None, 9, 1)], "g string, soldier_id int, tokens long")
    out = {r["soldier_id"]: r["batch"] for r in batching.token_batches(items, 10, "g").collect()}
    assert [out[i] for i in range(6)] == [0, 0, 1, 2, 3, 3]
    back = {r["soldier_id"]: r["batch"] for r in batching.token_batches(items, 10, "g", inverted=True).where("g = 'a'").collect()}
    assert [back[i] for i in (5, 4, 3, 2, 1, 0)] == [0, 0, 1, 2, 2, 3]


def test_tiers(spark):
    frame = spark.createDataFrame([(f"c{n}", f"{n}-{i}") for n in (1, 10, 12, 40) for i in range(n)], "component_id string, soldier_id string")
    tiers = {r["component_id"]: r["tier"] for r in thresholds.component_thresholds(frame).collect()}
    assert tiers == {"c1": "sparse", "c10": "under_represented", "c12": "adequately_represented", "c40": "well_represented"}


def test_runs(spark):
    schema = "pos int, pattern string, means string, tier string"
    f = spark.createDataFrame([(1, "A ", "old", "x"), (2, "a", "new", "strong"), (3, "b", "m", None)], schema)
    i = spark.createDataFrame([(1, "A", "i", "weak"), (2, "c", "m", None), (3, " ", "m", None)], schema)
    rows = {r["key"]: r for r in reconcile.compare_runs(f, i).collect()}
    assert rows["a"]["status"] == "robust" and rows["a"]["means"] == "new" and rows["a"]["final_confidence"] == "strong"
    assert {k for k, r in rows.items() if r["status"] == "order_dependent"} == {"b", "c"}


def test_metrics_cascade(spark):
    truth = spark.createDataFrame([("1", "c", "X", "1"), ("2", "c", "X", "2"), ("3", "d", "Y", None)], "soldier_id string, component_id string, division string, regiment string")
    answers = spark.createDataFrame([("1", "x", "1", "ROBUST"), ("2", "Z", "2", "odd"), ("3", "y", None, "strong")], "soldier_id string, division string, regiment string, confidence string")
    predictions = evaluate.parse_assignments(truth, answers, ("division", "regiment"))
    rows = {(r["scope"], r["name"]): r for r in evaluate.metrics(predictions, truth, ("division", "regiment")).collect()}
    whole = rows["overall", "all"]
    assert (whole["division_correct"], whole["regiment_correct"], whole["n_errors"]) == (2, 1, 0)
    assert rows["confidence", "tentative"]["n_predictions"] == 1
    assert whole["coverage"] == 1.0


def test_missing_answers_are_errors(spark):
    ids = spark.createDataFrame([("1",), ("2",)], "soldier_id string")
    answers = spark.createDataFrame([("1", "a", "strong")], "soldier_id string, division string, confidence string")
    rows = {r["soldier_id"]: r for r in evaluate.parse_assignments(ids, answers, ("division",)).collect()}
    assert rows["2"]["has_error"] and rows["2"]["confidence"] == "tentative" and not rows["1"]["has_error"]


def test_generated_rows_do_not_depend_on_partitions(spark):
    a = synth.soldiers(spark, 50, partitions=1).orderBy("soldier_id").collect()
    assert a == synth.soldiers(spark, 50, partitions=7).orderBy("soldier_id").collect()


def test_state_shares(spark):
    n = {r["n_states"]: r["count"] for r in synth.soldiers(spark, 4000).groupBy("n_states").count().collect()}
    assert n[1] / 4000 == pytest.approx(0.65, abs=0.03) and n[3] / 4000 == pytest.approx(0.07, abs=0.02)


def test_imperfect_texts_stay_texts(spark):
    frame = spark.range(200).select(synth.imperfect(F.lit("Alpha 1, Wing B / Element 2"), F.lit(5), 1, F.col("id")).alias("t"))
    texts = {r["t"] for r in frame.collect()}
    assert len(texts) > 5 and None not in texts
