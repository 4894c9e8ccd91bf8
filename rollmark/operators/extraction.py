"""Extraction of typed tokens and pairs from free text by glossary patterns.

One projection of built-in expressions over the text: eleven direct columns and eight derived
ones. Nothing is exploded and no Python runs; with ``dedupe_texts`` every distinct text is
parsed once, which pays where texts repeat a lot.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LETTER, join_name_notes, pair_left, pair_right, pair_term, strip_ordinal
from .glossary import NEVER, GlossaryForms

LB, RB = f"(?<!{LETTER})", f"(?!{LETTER})"
#: What may stand between the parts of a pair.
SEP = "[\\s\"“”'‘’:/\\^\\-,–—]*"

PAIR_COLUMNS = ("Org_Term_Digit_Term:Pair", "Unit_Term_Digit_Term:Pair", "Unit_Term_Alpha_Term:Pair", "Alpha_Digit:Pair")
SINGLE_COLUMNS = ("Unchar_Alpha", "Unchar_Digits", "Org_Terms", "Unit_Terms", "Role_Terms", "Digit_Sequences", "Special_Numbers")
#: Names of the two halves of each pair column.
SPLIT_COLUMNS = {
    "Org_Term_Digit_Term:Pair": ("Org_Term_Digit_Term:Org", "Org_Term_Digit_Term:Digit"),
    "Unit_Term_Digit_Term:Pair": ("Unit_Term_Digit_Term:Unit", "Unit_Term_Digit_Term:Digit"),
    "Unit_Term_Alpha_Term:Pair": ("Unit_Term_Alpha_Term:Unit", "Unit_Term_Alpha_Term:Alpha"),
    "Alpha_Digit:Pair": ("Alpha_Digit:Alpha", "Alpha_Digit:Digit"),
}


@dataclass(frozen=True)
class ExtractConfig:
    stem_threshold: int = 3
    max_suffix_len: int = 12
    num_min_len: int = 1
    num_max_len: int = 3
    alpha_letters: tuple[str, ...] = ("A", "B", "C", "D", "E", "F", "G")
    alpha_tokens: tuple[str, ...] = ()
    special_num_lengths: tuple[int, ...] = ()
    case_insensitive: bool = True


def _alpha(config: ExtractConfig) -> str:
    letters = "".join(sorted({c.strip().upper() for c in config.alpha_letters if c and c.strip()}))
    tokens = sorted({t.strip().upper() for t in config.alpha_tokens if t and t.strip()}, key=lambda t: (-len(t), t))
    parts = [r"\Q" + t + r"\E" for t in tokens] + ([f"[{letters}]"] if letters else [])
    return f"(?:{'|'.join(parts)})" if parts else NEVER


def patterns(forms: GlossaryForms, config: ExtractConfig = ExtractConfig()) -> dict[str, str]:
    """Java patterns by name. Pairs have groups 1, 2 (one order) and 3, 4 (the other)."""
    flags = "(?iu)" if config.case_insensitive else ""
    org, unit, role = (forms.alternation(t, config.stem_threshold, config.max_suffix_len) for t in ("organization term", "unit term", "role term"))
    alpha = _alpha(config)
    digits = f"[0-9]{{{config.num_min_len},{config.num_max_len}}}(?:st|nd|rd|th)?"
    either = lambda a, b: f"{flags}{LB}(?:({a}){SEP}({b})|({b}){SEP}({a})){RB}"
    out = {
        "org_digit": either(digits, org),
        "unit_digit": either(digits, unit),
        "unit_alpha": either(unit, alpha),
        "alpha_digit": either(alpha, digits),
        "alpha": f"{flags}(?<![0-9]){LB}({alpha})(?![0-9]){RB}",
        "digits": f"{flags}{LB}({digits}){RB}",
        "org": f"{flags}{LB}({org}){RB}",
        "unit": f"{flags}{LB}({unit}){RB}",
        "role": f"{flags}{LB}({role}){RB}",
        "sequence": f"{flags}({digits}(?:[/\\-:.]{digits})+)",
    }
    lengths = sorted({n for n in config.special_num_lengths if n > 0}, reverse=True)
    out["special"] = "(" + "|".join(f"(?<![0-9])[0-9]{{{n}}}(?![0-9])" for n in lengths) + ")" if lengths else f"({NEVER})"
    return out


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _pairs(text: Column, pattern: str, left: tuple[int, int], digit_right: bool) -> Column:
    """``LEFT:RIGHT`` of each match. left: the groups of the left part in either order."""
    right = {1: 2, 2: 1, 3: 4, 4: 3}
    zipped = F.arrays_zip(*[_all(text, pattern, g).alias(f"g{g}") for g in (1, 2, 3, 4)])
    pick = lambda m, a, b: F.coalesce(F.nullif(m[f"g{a}"], F.lit("")), m[f"g{b}"])

    def pair(m: Column) -> Column:
        rest = pick(m, right[left[0]], right[left[1]])
        return F.concat(pair_term(pick(m, *left)), F.lit(":"), strip_ordinal(rest) if digit_right else F.upper(rest))

    return F.transform(zipped, pair)


def extraction_columns(text: Column, compiled: dict[str, str]) -> dict[str, Column]:
    """The eleven direct columns."""
    upper = lambda name: F.transform(_all(text, compiled[name], 1), F.upper)
    sequence = lambda s: F.array_join(F.transform(F.split(s, r"[/\-:.]"), strip_ordinal), ":")
    return {
        "Org_Term_Digit_Term:Pair": _pairs(text, compiled["org_digit"], (2, 3), True),
        "Unit_Term_Digit_Term:Pair": _pairs(text, compiled["unit_digit"], (2, 3), True),
        "Unit_Term_Alpha_Term:Pair": _pairs(text, compiled["unit_alpha"], (1, 4), False),
        "Alpha_Digit:Pair": _pairs(text, compiled["alpha_digit"], (1, 4), True),
        "Unchar_Alpha": upper("alpha"),
        "Unchar_Digits": F.transform(_all(text, compiled["digits"], 1), strip_ordinal),
        "Org_Terms": upper("org"),
        "Unit_Terms": upper("unit"),
        "Role_Terms": upper("role"),
        "Digit_Sequences": F.transform(_all(text, compiled["sequence"], 1), sequence),
        "Special_Numbers": _all(text, compiled["special"], 1),
    }


def split_pairs(frame: DataFrame, columns: Iterable[str] = PAIR_COLUMNS) -> DataFrame:
    """The two halves of pair columns, aligned with them. An empty list gives empty lists."""
    out = {}
    for name in columns:
        left, right = SPLIT_COLUMNS.get(name, (f"{name}:Left", f"{name}:Right"))
        out[left] = F.transform(F.col(f"`{name}`"), pair_left)
        out[right] = F.transform(F.col(f"`{name}`"), pair_right)
    return frame.withColumns(out)


def extract(
    records: DataFrame,
    forms: GlossaryForms,
    config: ExtractConfig = ExtractConfig(),
    name_col: str = "Name",
    notes_col: str = "Notes",
    dedupe_texts: bool = False,
) -> DataFrame:
    """Add the nineteen extraction columns to records with name and notes."""
    compiled = patterns(forms, config)
    keyed = records.withColumn("_text", join_name_notes(F.col(name_col), F.col(notes_col)))
    if not dedupe_texts:
        return split_pairs(keyed.withColumns(extraction_columns(F.col("_text"), compiled))).drop("_text")
    parsed = keyed.select("_text").distinct().withColumns(extraction_columns(F.col("_text"), compiled))
    return split_pairs(keyed.join(parsed, "_text")).drop("_text")


def adapt_raw(raw: DataFrame) -> DataFrame:
    """Raw text as name, no notes; a missing raw_text is empty."""
    text = F.coalesce(F.col("raw_text").cast("string"), F.lit("")) if "raw_text" in raw.columns else F.lit("")
    return raw.withColumns({"Name": text, "Notes": F.lit("")})


def canonical_table(raw: DataFrame, forms: GlossaryForms, config: ExtractConfig = ExtractConfig(), core=("source_id", "soldier_id", "raw_text")) -> DataFrame:
    """Core columns, then the extraction columns in alphabetical order."""
    found = extract(adapt_raw(raw), forms, config)
    names = sorted([*PAIR_COLUMNS, *SINGLE_COLUMNS, *[n for pair in SPLIT_COLUMNS.values() for n in pair]])
    return found.select(*[c for c in core if c in raw.columns], *[F.col(f"`{n}`") for n in names])


def filled_shares(canonical: DataFrame, columns: Iterable[str]) -> DataFrame:
    """column and the share of rows with at least one token in it, in one pass."""
    columns = list(columns)
    shares = canonical.agg(*[F.avg((F.size(F.col(f"`{c}`")) > 0).cast("int")).alias(f"s{i}") for i, c in enumerate(columns)])
    return shares.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("share")) for i, c in enumerate(columns)])))
