"""Text, token and designator expressions. All are built-in functions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters as the extraction patterns see them: letters, letter numbers and other numbers.
LETTER = r"[\p{L}\p{Nl}\p{No}]"
#: Stands for a colon inside the left part of a pair token.
RATIO = "∶"
#: Separator between the name and the notes of a record.
PILCROW = " ¶ "


def normalize_text(text: Column, lower: bool = True) -> Column:
    """Null to empty, straight quotes, plain dashes, single spaces, trimmed, lower case (ß as ss)."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    out = F.translate(out, "“”‘’–—", "\"\"''--")
    out = F.trim(F.regexp_replace(out, r"[\s  - 　]+", " "))
    return F.replace(F.lower(out), F.lit("ß"), F.lit("ss")) if lower else out


def join_name_notes(name: Column, notes: Column) -> Column:
    """Name and notes as one text, normalised."""
    return F.concat(normalize_text(name), F.lit(PILCROW), normalize_text(notes))


def listify(text: Column) -> Column:
    """Abbreviations as an array: a JSON-like list in brackets, or parts at ``; , |``."""
    inner = F.regexp_replace(F.trim(text), r"^\[|\]$", "")
    bare = F.transform(F.split(inner, r"\s*[;,|]\s*"), lambda x: F.trim(F.regexp_replace(x, r"^\s*['\"]|['\"]\s*$", "")))
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.filter(bare, lambda x: x != ""))


def strip_ordinal(number: Column) -> Column:
    return F.regexp_replace(number, r"(?i)^([0-9]+)(?:st|nd|rd|th)$", "$1")


def pair_term(term: Column) -> Column:
    """A term that may stand left of the colon of a pair."""
    return F.upper(F.replace(term, F.lit(":"), F.lit(RATIO)))


def pair_left(pair: Column) -> Column:
    return F.substring_index(pair, ":", 1)


def pair_right(pair: Column) -> Column:
    """What follows the first colon; empty without one."""
    return F.when(F.instr(pair, ":") > 0, F.substring(pair, F.instr(pair, ":") + 1, F.length(pair))).otherwise("")


def canon_designator(value: Column) -> Column:
    """Digits without leading zeros, anything else trimmed in upper case; blank is null."""
    text = F.trim(value.cast("string"))
    digits = F.when(F.regexp_replace(text, "^0+", "") == "", "0").otherwise(F.regexp_replace(text, "^0+", ""))
    return F.when(text.rlike("^[0-9]+$"), digits).when(text == "", F.lit(None)).otherwise(F.upper(text))


def value_type(value: Column) -> Column:
    """numeric, alpha (one letter) or word."""
    return F.when(value.rlike("^[0-9]+$"), "numeric").when(value.rlike(r"^\p{L}$"), "alpha").otherwise("word")


def is_collision_designator(value: Column) -> Column:
    return value.rlike("^[0-9]+$") | value.rlike(r"^\p{L}$")


def titleize(token: Column) -> Column:
    return F.initcap(F.replace(token, F.lit("_"), F.lit(" ")))


def token_estimate(text: Column) -> Column:
    """Four characters a token; an empty or null text has none."""
    return F.floor(F.char_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def normalize_name(name: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(name)), "[.,]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def quoted_token(condition: Column) -> Column:
    """Text between the first pair of single quotes; empty without one."""
    return F.regexp_extract(condition, "'([^']*)'", 1)


def first_integer(condition: Column) -> Column:
    """The first stand-alone integer of a text."""
    return F.try_to_number(F.regexp_extract(condition, r"(?:^|\s)([0-9]+)(?=\s|$)", 1), F.lit("999999999")).cast("int")


def parse_home_unit(unit: Column) -> Column:
    """``branch:l1/l2/l3`` as (branch, levels)."""
    return F.struct(pair_left(unit).alias("branch"), F.filter(F.split(pair_right(unit), "/"), lambda x: x != "").alias("levels"))


def collision_entry(entry: Column) -> Column:
    """``branch.level`` as (branch, level); without a point all is branch."""
    level = F.when(F.instr(entry, ".") > 0, F.substring(entry, F.instr(entry, ".") + 1, F.length(entry))).otherwise("")
    return F.struct(F.substring_index(entry, ".", 1).alias("branch"), level.alias("level"))


def collision_key(key: Column) -> Column:
    """``(level, "value")`` as (level, canonical value); null if it does not parse."""
    pattern = r"^\(\s*([^,]+?)\s*,\s*(.+?)\s*\)$"
    level = F.lower(F.regexp_replace(F.regexp_extract(key, pattern, 1), "^['\"]|['\"]$", ""))
    value = canon_designator(F.regexp_replace(F.regexp_extract(key, pattern, 2), "^['\"]|['\"]$", ""))
    return F.when(key.rlike(pattern), F.struct(level.alias("level"), value.alias("value")))


def same_text(a: Column, b: Column) -> Column:
    """Equality without case; null on either side is not equal."""
    return F.coalesce(F.lower(a.cast("string")) == F.lower(b.cast("string")), F.lit(False))


def safe_ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b, 0 for a zero or null denominator."""
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), digits)


def hash_order(seed: int | str, *columns: Column) -> Column:
    """A reproducible random order: the MD5 of seed and key, equal in every SQL engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def hash_unit(seed: int | str, *columns: Column) -> Column:
    """A reproducible number in [0, 1) for each key: the first 32 bits of hash_order."""
    return F.conv(F.substring(hash_order(seed, *columns), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def json_from_text(text: Column) -> Column:
    """The JSON in a model's answer as text: the whole answer, a fenced block, the outermost
    braces, or the outermost brackets, whichever parses first; else null."""
    fence = F.regexp_extract(text, r"(?s)```(?:json|JSON)?\s*(.*?)```", 1)
    brace = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    bracket = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    tries = [F.to_json(F.try_parse_json(F.nullif(F.trim(x), F.lit("")))) for x in (text, fence, brace, bracket)]
    return F.coalesce(*tries)


def home_unit_key(branch: Column, levels: Column) -> Column:
    return F.concat(branch, F.lit(":"), F.array_join(F.slice(levels, 1, 3), "/"))


def level_map(pairs: list[tuple[str, Column]]) -> Column:
    """Sparse level columns as a map without nulls."""
    entries = [x for name, column in pairs for x in (F.lit(name), column.cast("string"))]
    return F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull())


def post_path(levels: Column, values: Column) -> Column:
    """Designators of a map in the order of the levels, joined by a slash."""
    return F.array_join(F.transform(levels, lambda x: F.coalesce(F.element_at(values, x), F.lit(""))), "/")
