"""Near copies of each text of an id that is repeated with different texts."""

from rollmark.llm import near_dedup

from .conftest import words


def edited(text):
    parts = text.split()
    return " ".join([*parts[:-1], "edited"])


def test_each_text_of_a_repeated_id_has_its_links(spark):
    texts = ["{} " + " ".join(words(120, seed, 3000)) for seed in (1, 2, 3, 4)]
    first, last, other, more = (t.format(w) for t, w in zip(texts, ("aaa", "zzz", "mmm", "nnn"), strict=True))
    rows = [(1, first), (1, last), (2, edited(last)), (3, edited(first)), (4, other), (9, edited(other)), (9, more), (10, edited(more)), (11, "alone")]
    found = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == {1: 1, 2: 1, 3: 1, 4: 4, 9: 4, 10: 4, 11: 11}
    assert {r["doc_id"]: r["class_size"] for r in found} == {1: 3, 2: 3, 3: 3, 4: 3, 9: 3, 10: 3, 11: 1}
    assert {r["doc_id"] for r in found if r["kept"]} == {1, 4, 11} and len(found) == len(rows)
