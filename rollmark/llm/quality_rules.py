"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule is a share measured on the whole text; a document whose share is above the rule's
cutoff is rejected. Cutoffs are tightened together, along a fixed ladder from lax to strict
that is chosen before any label is seen. For every stratum and step, labelled good rows held out for
this tell how many good documents the rules together reject; the step is certified if the exact
binomial tail, the probability of so few rejections were the true rate above ``risk``, is at
most ``delta`` divided by the number of strata (Bonferroni). The steps are tested in order and the
first failure ends the sequence, so they need no correction among themselves. The last
certified step gives the cutoffs; without one the rules are off in that stratum. With probability
``1 - delta`` no stratum loses more than ``risk`` of its good documents to all rules together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WORD_CLASS, documents, quoted, saved, text_or_empty

#: Steps of the ladder, and the strictest cutoff of each rule; all rules start at LAX. The last steps are
#: those of published rules for repeated lines and repeated three-word windows, rounded.
STEPS, LAX = 16, 0.9
STRICT = {"symbol_share": 0.02, "dup_line_share": 0.3, "repeat_share": 0.2, "upper_share": 0.2, "long_word_share": 0.05}
RULES = tuple(STRICT)
#: The ladder of each rule: equal ratios between steps.
LADDERS = {r: tuple(round(LAX * (low / LAX) ** (i / (STEPS - 1)), 4) for i in range(STEPS)) for r, low in STRICT.items()}
#: Strata with cutoffs that may be broadcast; beyond that the join is shuffled.
BROADCAST_STRATA = 10_000


def _let(value: Column, body) -> Column:
    """``body`` with ``value`` computed once for each row."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more, every word counted once.

    Windows are sorted by a 64-bit hash with their place; equal neighbours are the repeated
    ones. Texts without an equal pair of hashes end after a primitive sort.
    """

    def hashed(words: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        )

    def any_equal(ordered: Column) -> Column:
        return F.exists(F.sequence(F.lit(1), F.size(ordered) - 1), lambda j: F.get(ordered, j) == F.get(ordered, j - 1))

    def places(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(pairs: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(pairs, j)["h"] == x["h"], F.lit(False))
            return F.transform(F.filter(pairs, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])

        return F.sort_array(_let(pairs, repeated))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, j: F.when(j == 0, 3).otherwise(F.least(F.lit(3), p - F.get(places, j - 1))))
        return F.aggregate(steps, F.lit(0), lambda total, s: total + s)

    def count(hashes: Column) -> Column:
        return F.when((F.size(hashes) > 1) & _let(F.sort_array(hashes), any_equal), _let(places(hashes), covered)).otherwise(0)

    return F.when(F.size(words) >= 4, _let(hashed(words), count)).otherwise(0)


def measures(docs: DataFrame, id_col: str, text_col: str, stratum: Column) -> DataFrame:
    """Base measures and the rules' shares of every row."""
    source = docs.select(
        quoted(id_col).cast("long").alias("doc_id"), F.coalesce(stratum.cast("string"), F.lit("")).alias("stratum"), text_or_empty(quoted(text_col)).alias("text")
    )
    words = source.select("doc_id", "stratum", "text", F.regexp_extract_all("text", F.lit(f"({WORD_CLASS})"), F.lit(1)).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD_CLASS))
    counts = words.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("n_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _let(lines, F.size).cast("long").alias("n_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]{31}")).cast("long").alias("n_long"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return counts.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "symbol_share": share("n_symbols", "n_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "upper_share": share("n_upper", "n_chars"),
            "long_word_share": F.least(share("n_long", "n_words"), F.lit(1.0)),
        }
    )


def log_binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """log P(X <= k) for X binomial (n, rate), summed term by term in logarithms."""
    odds = math.log(rate) - math.log1p(-rate)
    first = n.cast("double") * F.lit(math.log1p(-rate))

    def step(state: Column, j: Column) -> Column:
        term = state["term"] + F.log((n - j + 1) / j) + F.lit(odds)
        high = F.greatest(state["total"], term)
        total = high + F.log1p(F.exp(-F.abs(state["total"] - term)))
        return F.struct(term.alias("term"), total.alias("total"))

    start = F.struct(first.alias("term"), first.alias("total"))
    folded = F.aggregate(F.sequence(F.lit(1).cast("long"), k), start, step, lambda s: s["total"])
    return F.when(k >= 1, folded).otherwise(first)


def certified_steps(held: DataFrame, risk: float, delta: float) -> DataFrame:
    """stratum, n (good rows), step: the last certified step of the ladder. ``held`` has the shares of good
    rows. Strata without a certified step are left out."""
    strata = max(1, held.select("stratum").distinct().count())
    # the first step at which a rule rejects the row; STEPS if it never does
    def stays(rule: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, LADDERS[rule])), lambda c: c >= F.col(rule)))

    first = held.select("stratum", F.least(*map(stays, RULES)).alias("first"))
    rejected = [F.sum((F.col("first") <= i).cast("long")) for i in range(STEPS)]
    counts = first.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.array(*rejected).alias("ks"))

    def fails(k: Column) -> Column:
        # a tail at or above its middle cannot be small: no need to add up its terms
        tail = F.when(k < F.col("n") * risk, log_binomial_tail(F.col("n"), k, risk)).otherwise(0.0)
        return tail > math.log(delta / strata)

    failed = F.filter(F.transform("ks", lambda k, i: F.when(fails(k), i)), lambda i: i.isNotNull())
    return counts.select("stratum", "n", (F.coalesce(F.array_min(failed), F.lit(STEPS)) - 1).alias("step")).where("step >= 0")


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum: Column | None = None,
    good_col: str = "quality",
    risk: float = 0.01,
    delta: float = 0.05,
) -> DataFrame:
    """One row per input row: base measures, base_failed, kept and the rules that failed.

    ``labels`` has the id and ``good_col`` (1: good). Strata default to the column ``lang``.
    Null texts have no words and fail the base; a null stratum is a stratum of its own. Rows
    with a null id are measured and judged, but never matched with a label. Of an id labelled
    more than once, a good label counts. Strata in which no step is certified are judged by
    the base alone; without a rejection it takes ``log(delta / strata) / log(1 - risk)`` good rows. An empty table gives an empty result; other columns are ignored.
    """
    stratum = quoted("lang") if stratum is None else stratum
    measured = saved(measures(docs, id_col, text_col, stratum))
    good = labels.where(quoted(good_col) == 1).select(quoted(id_col).cast("long").alias("doc_id")).distinct()
    held = measured.where("NOT base_failed").join(good, "doc_id", "left_semi")
    steps = certified_steps(held, risk, delta)
    cutoffs = saved(steps.select("stratum", *[F.element_at(F.array(*map(F.lit, LADDERS[r])), F.col("step") + 1).alias(f"{r}_cutoff") for r in RULES]))
    if cutoffs.count() <= BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    failed = F.array_compact(F.array(*[F.when(F.col(r) > F.col(f"{r}_cutoff"), F.lit(r)) for r in RULES]))
    judged = measured.join(cutoffs, "stratum", "left").withColumn("failed_rules", failed)
    return judged.select(
        "doc_id",
        "n_words",
        "n_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"),
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_RISK, _DELTA = 0.01, 0.05
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, stratum, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), win AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS h FROM w, unnest(generate_series(1, len(words) - 2)) AS g(i)
), rep AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM rep, unnest([i, i + 1, i + 2]) AS g(p) GROUP BY doc_id
), m AS (
  SELECT doc_id, stratum, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS n_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
         coalesce(cov.n, 0) AS n_repeat_words, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(t, '[^\x20\x09-\x0D]{{31}}')) AS n_long
  FROM w LEFT JOIN cov USING (doc_id)
), s AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         coalesce(n_symbols / nullif(n_chars, 0), 0) AS symbol_share, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_share,
         coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_share, coalesce(n_upper / nullif(n_chars, 0), 0) AS upper_share,
         least(coalesce(n_long / nullif(n_words, 0), 0), 1) AS long_word_share
  FROM m
), held AS (
  SELECT * FROM s WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
), ladder(step, {", ".join(RULES)}) AS (
  VALUES {", ".join("(" + ", ".join([str(i), *(f"CAST({LADDERS[r][i]} AS DOUBLE)" for r in RULES)]) + ")" for i in range(STEPS))}
), counts AS (
  SELECT h.stratum, l.step, count(*) AS n, count(*) FILTER ({" OR ".join(f"h.{r} > l.{r}" for r in RULES)}) AS k
  FROM held h, ladder l GROUP BY h.stratum, l.step
), tested AS (
  SELECT stratum, step, k < n * {_RISK} AND (
    SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_RISK}) + (n - j) * ln(1 - {_RISK}))) FROM unnest(generate_series(0, k)) AS g(j)
  ) <= {_DELTA} / (SELECT count(DISTINCT stratum) FROM held) AS passed FROM counts
), certified AS (
  SELECT stratum, max(step) AS step FROM tested t
  WHERE NOT EXISTS (SELECT 1 FROM tested u WHERE u.stratum = t.stratum AND u.step <= t.step AND NOT u.passed) GROUP BY stratum
), cutoffs AS (
  SELECT c.stratum, l.* FROM certified c JOIN ladder l USING (step)
), judged AS (
  SELECT s.*, array_to_string(list_filter([{", ".join(f"CASE WHEN s.{r} > c.{r} THEN '{r}' END" for r in RULES)}], lambda x: x IS NOT NULL), ',') AS failed_rules
  FROM s LEFT JOIN cutoffs c USING (stratum)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_chars AS BIGINT) AS n_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce(failed_rules, '') = '' AS kept, coalesce(failed_rules, '') AS failed_rules
FROM judged
"""
