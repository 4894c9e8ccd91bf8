"""Scalar functions and extraction on literal texts."""

import pytest
from pyspark.sql import functions as F

from rollmark.functions import text as T
from rollmark.operators import extraction
from rollmark.operators.glossary import GlossaryForms


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).head()["y"]


@pytest.mark.parametrize(
    ("f", "value", "wanted"),
    [
        (T.normalize_text, "  “Ä”\t– Straße ", '"ä" - strasse'),
        (T.normalize_text, None, ""),
        (T.listify, "a; b,c | d", ["a", "b", "c", "d"]),
        (T.listify, "['x', \"y\"]", ["x", "y"]),
        (T.listify, None, []),
        (T.strip_ordinal, "21ST", "21"),
        (T.canon_designator, " 007 ", "7"),
        (T.canon_designator, "000", "0"),
        (T.canon_designator, " ab ", "AB"),
        (T.canon_designator, "  ", None),
        (T.quoted_token, "contains term 'wing'", "wing"),
        (T.first_integer, "path has 5 levels (branch only has 3)", 5),
        (T.token_estimate, "123456789", 2),
        (T.token_estimate, None, 0),
        (T.pair_term, "a:b", "A∶B"),
        (T.json_from_text, 'x ```json\n{"a": 1}\n``` y', '{"a":1}'),
        (T.json_from_text, 'so: [1, 2] ok', "[1,2]"),
        (T.json_from_text, "none", None),
        (T.normalize_name, " Mr. Foo,  B ", "mr foo b"),
    ],
)
def test_scalars(spark, f, value, wanted):
    assert one(spark, value, f) == wanted


def test_structs(spark):
    assert tuple(one(spark, '(fleet, "3")', T.collision_key)) == ("fleet", "3")
    assert one(spark, "nonsense", T.collision_key) is None
    assert tuple(one(spark, "a.b.c", T.collision_entry)) == ("a", "b.c")
    assert tuple(one(spark, "b:x/y", T.parse_home_unit)) == ("b", ["x", "y"])


FORMS = GlossaryForms().add("fleet", ["flt"], "Unit Term").add("Colonial Service", ["CS"], "Organization Term").add("pilot", [], "Role Term")


def extracted(spark, *texts, **config):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, raw_text string")
    out = extraction.extract(extraction.adapt_raw(frame), FORMS, extraction.ExtractConfig(**config)).orderBy("id")
    return [r.asDict() for r in out.collect()]


def test_pairs_in_either_order(spark):
    a, b, c = extracted(spark, "Fleet 3", "2nd fleet", "CS-12, flt: B")
    assert a["Unit_Term_Digit_Term:Pair"] == ["FLEET:3"]
    assert b["Unit_Term_Digit_Term:Pair"] == ["FLEET:2"]
    assert c["Org_Term_Digit_Term:Pair"] == ["CS:12"] and c["Unit_Term_Alpha_Term:Pair"] == ["FLT:B"]
    assert c["Unit_Term_Alpha_Term:Unit"] == ["FLT"] and c["Unit_Term_Alpha_Term:Alpha"] == ["B"]


def test_stems_boundaries_and_sequences(spark):
    a, b = extracted(spark, "fleeters 1/2nd/116 and pilots", "flts xfleet CS")
    assert a["Unit_Terms"] == ["FLEETERS"] and a["Role_Terms"] == ["PILOTS"]
    assert a["Digit_Sequences"] == ["1:2:116"]
    assert b["Unit_Terms"] == [] and b["Org_Terms"] == ["CS"]


def test_empty_and_null_texts(spark):
    for row in extracted(spark, "", None):
        assert all(v == [] for k, v in row.items() if isinstance(v, list))


def test_long_numbers_and_specials(spark):
    (a,) = extracted(spark, "1944 D 7", special_num_lengths=(4,))
    assert a["Special_Numbers"] == ["1944"] and "7" in a["Unchar_Digits"]
    assert a["Alpha_Digit:Pair"] == ["D:4"] or a["Alpha_Digit:Pair"] == ["D:7"] or a["Alpha_Digit:Pair"] == ["D:944"]
