"""Prompt texts as columns: templates over arrays, cut to fixed numbers of entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_PATTERNS, MOST_TERMS, MOST_TEXTS, MOST_RECONCILED, MOST_CASES = 10, 5, 5, 30, 10


def bullets(items: Column, most: int, indent: str = "  - ") -> Column:
    return F.array_join(F.transform(F.slice(items, 1, most), lambda x: F.concat(F.lit(indent), x)), "\n")


def section(title: str, body: Column) -> Column:
    """A titled section; nothing at all for an empty body."""
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"{title}:\n"), body)).otherwise("")


def joined(*sections: Column) -> Column:
    return F.array_join(F.filter(F.array(*sections), lambda s: s != ""), "\n\n")


def pattern_lines(patterns: Column, most: int = MOST_PATTERNS) -> Column:
    """patterns: array of (pattern, means, tier)."""
    line = lambda p: F.format_string("'%s' [%s]: %s", p["pattern"], F.coalesce(p["tier"], F.lit("tentative")), F.coalesce(p["means"], F.lit("")))
    return bullets(F.transform(F.slice(patterns, 1, most), line), most)


def entity_lines(entities: Column, most: int = MOST_TEXTS) -> Column:
    """entities: array of (id, texts)."""
    return F.array_join(F.transform(entities, lambda e: F.concat(F.lit("["), e["id"].cast("string"), F.lit("]\n"), bullets(e["texts"], most))), "\n")


def consolidation_prompt(name: Column, structure: Column, patterns: Column, terms: Column, rules: Column, entities: Column) -> Column:
    """Assign the entities of a batch to units of a component."""
    return joined(
        F.format_string("Assign %d entities to units of %s from their records.", F.size(entities), name),
        section("STRUCTURE", structure),
        section("PATTERNS", pattern_lines(patterns)),
        section("VOCABULARY", bullets(terms, MOST_TERMS)),
        section("EXCLUSIONS", bullets(rules, MOST_TERMS)),
        section("RECORDS", entity_lines(entities)),
        F.lit('Answer with JSON: {"assignments": [{"soldier_id", "levels", "confidence": "robust|strong|moderate|tentative", "reasoning"}]}'),
    )


def discovery_head(component: Column, rival: Column, texts_a: Column, texts_b: Column) -> Column:
    """Find patterns that tell a component from a rival; what is known so far comes between this and DISCOVERY_TAIL."""
    return joined(
        F.format_string("Find text patterns that tell %s from %s.", component, rival),
        section("RECORDS A", bullets(texts_a, 15)),
        section("RECORDS B", bullets(texts_b, 15)),
    )


DISCOVERY_TAIL = 'Answer with JSON: {"patterns": [{"pattern", "means", "tier"}], "hard_cases": [{"soldier_id", "layer", "reason"}]}'


def discovery_prompt(component: Column, rival: Column, texts_a: Column, texts_b: Column, known: Column) -> Column:
    """The whole prompt, for patterns that are known beforehand."""
    return joined(discovery_head(component, rival, texts_a, texts_b), section("KNOWN PATTERNS", bullets(known, 25)), F.lit(DISCOVERY_TAIL))


def vocabulary_prompt(component: Column, texts: Column) -> Column:
    return joined(
        F.format_string("List the words that mark records of %s.", component),
        section("RECORDS", bullets(texts, 25)),
        F.lit('Answer with JSON: {"vocabulary": [{"term", "strength": "strong|moderate|weak"}]}'),
    )


def reconciliation_prompt(component: Column, forward: Column, inverted: Column, cases: Column) -> Column:
    return joined(
        F.format_string("Two runs over %s disagree. Judge each pattern.", component),
        section("FORWARD", pattern_lines(forward, MOST_RECONCILED)),
        section("INVERTED", pattern_lines(inverted, MOST_RECONCILED)),
        section("HARD CASES", bullets(cases, MOST_CASES)),
        F.lit('Answer with JSON: {"verdicts": [{"pattern", "status": "robust|validated|order_dependent|rejected", "confidence", "notes"}]}'),
    )
