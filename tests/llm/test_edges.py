"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

from rollmark.llm import exact_dedup, language_id, line_templates, near_dedup, packing, pieces, quality_classifier, quality_rules, substring_dedup, toxicity


def run(name, docs, labels):
    return {
        "op1": lambda: pieces.encode_pieces(docs),
        "op2": lambda: line_templates.line_dedup(docs),
        "op3": lambda: packing.pack_documents(docs),
        "op4": lambda: quality_rules.quality_rules(docs, labels),
        "op5": lambda: near_dedup.near_dedup(docs),
        "op6": lambda: toxicity.toxicity(docs, labels),
        "op7": lambda: language_id.language_id(docs),
        "op8": lambda: quality_classifier.quality_classifier(docs),
        "op9": lambda: exact_dedup.exact_dedup(docs),
        "op10": lambda: substring_dedup.substring_dedup(docs),
        "keep_good": lambda: quality_classifier.keep_good(docs),
        "cut_repeats": lambda: substring_dedup.cut_repeats(docs),
    }[name]()


NAMES = ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "keep_good", "cut_repeats"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, empty, labels, name):
    assert run(name, empty, labels.limit(0)).collect() == []


@pytest.fixture(scope="module")
def results(edge, labels):
    return {name: run(name, edge, labels).collect() for name in NAMES}


def by_id(rows, doc_id):
    return [r for r in rows if r["doc_id"] == doc_id]


@pytest.mark.parametrize("name", [n for n in NAMES if n not in ("op3", "keep_good")])
def test_one_row_for_each_row(results, edge_rows, name):
    assert sorted(str(r["doc_id"]) for r in results[name]) == sorted(str(r[0]) for r in edge_rows)


def test_pieces(results):
    assert all(r["round_trip"] for r in results["op1"])
    assert [by_id(results["op1"], i)[0]["n_ids"] for i in (2, 3)] == [0, 0]


def test_lines(results):
    assert by_id(results["op2"], 2)[0]["kept_text"] == "" and by_id(results["op2"], 2)[0]["n_lines"] == 0
    assert by_id(results["op2"], 10)[0]["n_lines"] == 3


def test_pieces_of_sequences(results, edge_rows):
    rows = results["op3"]
    assert sum(r["start"] == 0 for r in rows) == len(edge_rows)
    assert by_id(rows, 2)[0]["doc_tokens"] == 1
    at = 0
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["sequence_id"] * 2048 + r["offset"] == at
        at += r["length"]


def test_base_rules(results):
    for i in (2, 3, 4, 9, 10):
        assert by_id(results["op4"], i)[0]["base_failed"] and not by_id(results["op4"], i)[0]["kept"]
    assert by_id(results["op4"], 1)[0]["kept"]
    assert by_id(results["op4"], 10)[0]["n_dup_lines"] == 1


def test_near_classes(results):
    rows = results["op5"]
    classes = {r["doc_id"]: r["class_id"] for r in rows}
    assert classes[1] == classes[7] == classes[8] == 1 and classes[5] == classes[6] == 5
    assert classes[2] == classes[3] == classes[4] == 2 and classes[None] is None
    assert by_id(rows, None)[0]["kept"] and by_id(rows, 1)[0]["class_size"] == 3
    assert not any(r["kept"] for r in by_id(rows, 8))


def test_scores(results):
    assert all(0 <= r["score"] <= 1 for r in results["op6"] + results["op7"] + results["op8"])
    for i in (2, 3, 4):
        assert by_id(results["op7"], i)[0]["lang_pred"] == "und" and not by_id(results["op8"], i)[0]["kept"]
    assert by_id(results["op6"], None)[0]["held_out"]


def test_exact_groups(results):
    rows = results["op9"]
    assert {r["keep_id"] for r in rows if r["doc_id"] in (1, 7, None)} == {7}
    assert [r["group_size"] for r in by_id(rows, 1)] == [4]
    assert sorted(r["kept"] for r in by_id(rows, 7)) == [False, True]
    assert sum(r["kept"] for r in rows if r["doc_id"] in (2, 3, 4)) == 1 and by_id(rows, 4)[0]["kept"]
    assert by_id(rows, 2)[0]["text_sha256"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_passages(results):
    rows = results["op10"]
    assert [r["n_removed"] for r in by_id(rows, 1) + by_id(rows, 5) + by_id(rows, None)] == [0, 0, 0]
    assert [r["n_removed"] for r in by_id(rows, 7)] == [120, 120]
    assert by_id(rows, 6)[0]["n_removed"] == 60_000 and by_id(rows, 8)[0]["n_removed"] == 119


def test_rows_keep_their_columns(results, edge):
    assert results["keep_good"][0].asDict().keys() == set(edge.columns)
    assert all(r["text"] for r in results["keep_good"])
    assert results["cut_repeats"][0].asDict().keys() == set(edge.columns)
    assert by_id(results["cut_repeats"], 6)[0]["text"] == "tail"


# ---- stages of the pipeline ----


def stage(spark, name, docs):
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)[name](spark, docs, None)


STAGES = ["quality classifier", "exact dedup", "near dedup", "substring dedup", "packing"]


@pytest.mark.parametrize("name", STAGES)
def test_stage_of_an_empty_table(spark, empty, name):
    assert stage(spark, name, empty).collect() == []


@pytest.fixture(scope="module")
def odd(edge):
    """The edge rows, with the names that the stages use inside."""
    names = {"uid": "kept_id", "digest": "sha", "norm": "_sha", "spans": "c0", "label": "cut_id", "node": "nth", "part": "kept_sha"}
    return edge.withColumnsRenamed(names).cache()


@pytest.mark.parametrize("name", STAGES[:-1])
def test_stage_keeps_columns_and_edges(spark, odd, name):
    found = stage(spark, name, odd)
    assert found.columns == odd.columns
    rows = found.collect()
    ids = sorted(str(r["doc_id"]) for r in rows)
    if name == "quality classifier":
        assert all(r["text"] and r["text"].strip() for r in rows) and ids.count("7") == 2
    if name == "exact dedup":  # 1, 7, 7 and the null id have one text; 2, 3 and 4 none
        assert ids == sorted(["4", "5", "6", "7", "8", "9", "10", "11", "12"])
    if name == "near dedup":  # 1, 7 and 8; 5 and 6; 2, 3 and 4
        assert ids == sorted(["1", "2", "5", "9", "10", "11", "12", "None"])
    if name == "substring dedup":
        assert len(rows) == odd.count()
        texts = {r["doc_id"]: r for r in rows}
        assert texts[6]["text"] == "tail" and texts[6]["n_chars"] == 4 and texts[2]["text"] is None and texts[2]["n_chars"] is None
