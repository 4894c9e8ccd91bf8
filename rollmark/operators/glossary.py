"""Glossaries: from hierarchies, deduplicated, and as alternations for extraction patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.relational import first_per
from ..functions.text import LETTER, is_collision_designator, titleize

TERM_TYPES = {"organization term": "ORG", "unit term": "UNIT", "role term": "ROLE"}
#: Never matches; keeps the layout of groups where a type has no terms.
NEVER = "(?!x)x"


def glossary_terms(dims: DataFrame, branch_terms: DataFrame | None = None) -> DataFrame:
    """Terms of a hierarchy: branches (organisation terms), levels and named designators (unit terms).

    Digits and single letters name nothing, so they are left out. ``branch_terms`` may give
    abbreviations: branch, abbreviations.
    """
    empty = F.array().cast("array<string>")
    branches = dims.select("branch").distinct()
    if branch_terms is not None:
        branches = branches.join(branch_terms, "branch", "left")
    else:
        branches = branches.withColumn("abbreviations", empty)
    org = branches.select(titleize(F.col("branch")).alias("full_term"), F.coalesce("abbreviations", empty).alias("abbreviations"), F.lit("Organization Term").alias("term_type"))
    level = dims.select("level").distinct().select(titleize(F.col("level")).alias("full_term"), empty.alias("abbreviations"), F.lit("Unit Term").alias("term_type"))
    named = dims.where(~is_collision_designator(F.col("value"))).select("value").distinct()
    named = named.select(titleize(F.col("value")).alias("full_term"), empty.alias("abbreviations"), F.lit("Unit Term").alias("term_type"))
    return dedupe_terms(
        org.withColumn("priority", F.lit(1)).unionByName(level.withColumn("priority", F.lit(2))).unionByName(named.withColumn("priority", F.lit(3)))
    )


def role_terms(spark) -> DataFrame:
    """No role terms are known of a hierarchy: an empty relation of the glossary's schema."""
    return spark.createDataFrame([], "full_term string, abbreviations array<string>, term_type string")


def dedupe_terms(terms: DataFrame) -> DataFrame:
    """One row per full term: all its abbreviations, and the type that comes first by priority."""
    merged = terms.groupBy("full_term").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("abbreviations")))).alias("abbreviations"))
    kinds = first_per(terms.select("full_term", "term_type", "priority"), ["full_term"], F.col("priority"), F.col("term_type")).drop("priority")
    return merged.join(kinds, "full_term")


def ordered_terms(terms: DataFrame) -> DataFrame:
    order = F.when(F.col("term_type") == "Organization Term", 1).when(F.col("term_type") == "Unit Term", 2).otherwise(3)
    return terms.orderBy(order, "full_term")


def normalize_form(text: str) -> str:
    text = text.translate(str.maketrans("“”‘’–—", "\"\"''--"))
    return re.sub(r"\s+", " ", text).strip().lower().replace("ß", "ss")


def java_literal(form: str) -> str:
    """A form as a Java pattern, any white space between its words."""
    return r"\s+".join(re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", w) for w in form.split(" "))


@dataclass
class GlossaryForms:
    """Surface forms by type; the vocabulary of an organisation, held by the driver."""

    forms: dict[str, set[str]] = field(default_factory=lambda: {t: set() for t in TERM_TYPES})
    canonical: dict[str, tuple[str, str]] = field(default_factory=dict)

    def add(self, term: str, abbreviations: list[str], kind: str) -> GlossaryForms:
        kind = normalize_form(kind)
        if kind not in self.forms:
            raise ValueError(f"unknown term type: {kind!r}")
        full = normalize_form(term)
        for form in [full, *map(normalize_form, abbreviations or [])]:
            if form:
                self.forms[kind].add(form)
                self.canonical[form] = (full, kind)
        return self

    @classmethod
    def of(cls, terms: DataFrame) -> GlossaryForms:
        out = cls()
        for row in terms.select("full_term", "abbreviations", "term_type").collect():
            out.add(row[0], row[1], row[2])
        return out

    def alternation(self, kind: str, stem_threshold: int, max_suffix: int) -> str:
        """Longest forms first. Short ones stand alone, longer ones may carry a suffix of letters."""
        forms = sorted(self.forms[kind], key=lambda f: (-len(f), f))
        short = [java_literal(f) for f in forms if len(f) <= stem_threshold]
        long = [java_literal(f) + LETTER + f"{{0,{max_suffix}}}" for f in forms if len(f) > stem_threshold]
        short_part = f"(?:{'|'.join(short)})(?!{LETTER})" if short else NEVER
        return f"(?:{short_part}|{'|'.join(long) if long else NEVER})"
