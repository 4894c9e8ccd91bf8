"""Passes of the annotator: every prompt once, and answers that depend on the order."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from rollmark.operators import annotate, reconcile
from rollmark.plans import pipelines


def batches(spark):
    rows = [(c, f"r{k}", k, f"Tell {c} from r{k}.", "Answer with JSON.") for c in ("a", "b") for k in range(4)]
    return spark.createDataFrame(rows, "component string, batch_key string, batch long, head string, tail string").repartition(3)


def first_word_wins(prompts):
    """One pattern that depends on what is known, one that does not."""
    out = []
    for prompt in prompts:
        rival = re.search(r"from (r\d)", prompt)[1]
        new = [] if "KNOWN PATTERNS" in prompt else [{"pattern": f"first {rival}", "means": "x", "tier": "strong"}]
        out.append("Sure:\n```json\n" + json.dumps({"patterns": [*new, {"pattern": f"Word {rival}", "means": rival, "tier": "strong"}]}) + "\n```")
    return out


def test_order_shows(spark):
    passes = [pipelines._patterns(annotate.discover(batches(spark), first_word_wins, inverted=i)) for i in (False, True)]
    found = {(r["component"], r["key"]): r["status"] for r in reconcile.dual_run(*passes, "component", "batch").collect()}
    assert {k: v for k, v in found.items() if k[1].startswith("word")} == {(c, f"word r{k}"): "robust" for c in "ab" for k in range(4)}
    assert {k: v for k, v in found.items() if k[1].startswith("first")} == {(c, f"first {r}"): "order_dependent" for c in "ab" for r in ("r0", "r3")}


def test_known_patterns_are_shown_once(spark):
    rows = {(r["component"], r["batch"]): r["prompt"] for r in annotate.discover(batches(spark), first_word_wins).collect()}
    assert "KNOWN" not in rows["a", 0]
    assert rows["a", 2].split("\n\n")[1] == "KNOWN PATTERNS:\n  - first r0\n  - Word r0\n  - Word r1"


def test_each_prompt_is_sent_once_a_pass(spark, tmp_path):
    folder = str(tmp_path)

    def counting(prompts):
        for _ in prompts:
            with open(os.path.join(folder, f"{os.getpid()}"), "a") as out:
                out.write("x")
        return annotate.mock_annotator(prompts)

    validation = spark.createDataFrame([(c, f"{c}{i}", "seg", "s") for c in "xyz" for i in range(3)], "component string, soldier_id string, level string, value string")
    raw = validation.select("soldier_id", F.concat(F.lit("Seen near Harbour "), "soldier_id").alias("raw_text"))
    structure = spark.createDataFrame([(c, "port", 2, ["seg"]) for c in "xyz"], "component string, branch string, depth int, levels array<string>")
    designators = spark.createDataFrame([(c, "seg", "s") for c in "xyz"], "component string, level string, value string")
    rules = spark.createDataFrame([("x", "term_presence", "zzz", None)], "component string, rule_type string, if_contains string, if_depth int")
    made = pipelines.generate_artifacts(spark, validation, raw, structure, designators, rules, counting)
    assert made.count() == 3 and made.count() == 3
    assert sum(os.path.getsize(os.path.join(folder, f)) for f in os.listdir(folder)) == 2 * 3  # pairs xy, xz, yz; two passes


def test_calls_are_repeated_and_errors_kept(spark):
    def fails(prompts):
        raise RuntimeError("no such model")

    rows = annotate.discover(batches(spark), fails).collect()
    assert len(rows) == 8 and all(r["answer"] is None and r["error"] == "no such model" for r in rows)
    waits, turns = [], []

    def busy(prompts):
        turns.append(1)
        if len(turns) < 3:
            raise RuntimeError("rate limit")
        return ["ok"]

    assert annotate.with_retries(busy, 3, sleep=waits.append)(["p"]) == ["ok"] and waits == [1.0, 2.0]
    with pytest.raises(RuntimeError):
        annotate.with_retries(fails, 3, sleep=waits.append)(["p"])
    assert len(waits) == 2


@pytest.mark.parametrize(("text", "wanted"), [(None, None), ("no", None), ('{"a": 1}', {"a": 1}), ("x ```json\n[1]\n``` y", [1]), ('so {"a": 2} it is', {"a": 2}), ("so [2, 3]", [2, 3])])
def test_json_of_answers(text, wanted):
    assert annotate.answer_json(text) == wanted
