"""Extraction over part descriptions and documents, and scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extraction
from ..operators.glossary import GlossaryForms
from .base import Tables, joined

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def forms() -> GlossaryForms:
    return GlossaryForms().add("brand", ["brnd"], "Unit Term").add("size", [], "Unit Term").add("widget", [], "Organization Term").add("plate", ["pl"], "Organization Term").add("cold", ["hot"], "Role Term")


def part_text(t: Tables):
    text = F.concat_ws(" ", "p_type", F.replace(F.col("p_brand"), F.lit("#"), F.lit(" ")), "p_name", F.lit("size"), F.col("p_size").cast("string"), F.expr("substring('ABCDEFGH', p_size % 8 + 1, 1)"))
    return t.part.select(F.col("p_partkey").alias("soldier_id"), text.alias("raw_text"))


# Boundaries are made consumable: single spaces become three, so that neighbouring matches do not
# share one. Texts of this table have spaces only between words.
PADDED = """src AS (
  SELECT p_partkey AS soldier_id, concat_ws(' ', p_type, replace(p_brand, '#', ' '), p_name, 'size', CAST(p_size AS VARCHAR), substring('ABCDEFGH', p_size % 8 + 1, 1)) AS raw_text FROM part
), norm AS (
  SELECT soldier_id, lower(trim(regexp_replace(raw_text, '\\s+', ' ', 'g'))) || ' ¶ ' AS t FROM src
), padded AS (
  SELECT soldier_id, '   ' || replace(t, ' ', '   ') || '   ' AS t FROM norm
)"""
_DIGITS = "[0-9]{1,3}(?:st|nd|rd|th)?"
_UNIT = "(?:(?:brand|brnd|size)\\p{L}{0,12})"
_ORG = "(?:pl|(?:widget|plate)\\p{L}{0,12})"
_ALPHA = "[a-g]"


def _pairs_sql(a: str, b: str, left: str) -> str:
    """Pairs of a and b in either order as LEFT:RIGHT, in order of appearance. The left part is b or a."""
    pattern = f"[^\\p{{L}}](?:({a})[\\s]*({b})|({b})[\\s]*({a}))[^\\p{{L}}]"
    l1, r1, l2, r2 = (2, 1, 3, 4) if left == "b" else (1, 2, 4, 3)
    g = [f"regexp_extract_all(t, '{pattern}', {i})" for i in range(5)]
    return f"""array_to_string(list_transform(generate_series(1, len({g[1]})), lambda i:
      upper(CASE WHEN ({g[l1]})[i] <> '' THEN ({g[l1]})[i] ELSE ({g[l2]})[i] END) || ':' ||
      upper(regexp_replace(CASE WHEN ({g[r1]})[i] <> '' THEN ({g[r1]})[i] ELSE ({g[r2]})[i] END, '^([0-9]+)(st|nd|rd|th)$', '\\1'))), ',')"""


def _extracted(t: Tables):
    return extraction.extract(extraction.adapt_raw(part_text(t)), forms())


def _pair_query(name: str, column: str, a: str, b: str, left: str):
    sql = f"WITH {PADDED} SELECT soldier_id, {_pairs_sql(a, b, left)} AS pairs FROM padded"

    def run(spark, sf_dir):
        return _extracted(Tables(spark, sf_dir)).select("soldier_id", F.upper(joined(F.col(f"`{column}`"))).alias("pairs"))

    QUERIES[name], ORACLES[name] = run, sql


_pair_query("pair_extract_unit_digit", "Unit_Term_Digit_Term:Pair", _DIGITS, _UNIT, "b")
_pair_query("pair_extract_org_digit", "Org_Term_Digit_Term:Pair", _DIGITS, _ORG, "b")
_pair_query("pair_extract_unit_alpha", "Unit_Term_Alpha_Term:Pair", _UNIT, _ALPHA, "a")
_pair_query("pair_extract_alpha_digit", "Alpha_Digit:Pair", _ALPHA, _DIGITS, "a")


def _single_sql(pattern: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(t, '[^\\p{{L}}]({pattern})[^\\p{{L}}]', 1), lambda x: upper(x)), ',')"


@query(f"""WITH {PADDED} SELECT soldier_id, {_single_sql(_UNIT)} AS unit_terms, {_single_sql(_ORG)} AS org_terms, {_single_sql('(?:(?:cold)[a-z]{0,12}|hot)')} AS role_terms,
array_to_string(list_transform(regexp_extract_all(t, '[^\\p{{L}}0-9]([a-g])[^\\p{{L}}0-9]', 1), lambda x: upper(x)), ',') AS alpha FROM padded""")
def standalone_terms(t):
    return _extracted(t).select("soldier_id", joined("Unit_Terms").alias("unit_terms"), joined("Org_Terms").alias("org_terms"), joined("Role_Terms").alias("role_terms"), joined("Unchar_Alpha").alias("alpha"))


@query(f"WITH {PADDED} SELECT soldier_id, array_to_string(regexp_extract_all(t, '[^\\p{{L}}]([0-9]{{1,3}})[^\\p{{L}}]', 1), ',') AS digits FROM padded")
def unchar_digits(t):
    return _extracted(t).select("soldier_id", joined("Unchar_Digits").alias("digits"))


@query("""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '([0-9]{1,3}(?:st|nd|rd|th)?(?:[/\\-:.][0-9]{1,3}(?:st|nd|rd|th)?)+)', 1),
  lambda x: array_to_string(list_transform(regexp_split_to_array(x, '[/\\-:.]'), lambda y: regexp_replace(y, '^([0-9]+)(st|nd|rd|th)$', '\\1')), ':')), ',') AS sequences
FROM documents""")
def digit_sequences(t):
    docs = t.documents.select("doc_id", F.col("text").alias("Name"), F.lit("").alias("Notes"))
    return extraction.extract(docs, forms()).select("doc_id", joined("Digit_Sequences").alias("sequences"))


@query("""SELECT user_id, event_type || ':' || CAST(user_id AS VARCHAR) || ':x' AS pair, upper(event_type) AS l, CAST(user_id AS VARCHAR) || ':x' AS r, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id, event_type""")
def pair_split(t):
    pairs = t.events.select("user_id", F.concat_ws(":", "event_type", F.col("user_id").cast("string"), F.lit("x")).alias("pair"))
    split = extraction.split_pairs(pairs.groupBy("user_id", "pair").agg(F.count(F.lit(1)).alias("n"), F.collect_set("pair").alias("P:Pair")), ["P:Pair"])
    return split.select("user_id", "pair", F.upper(F.col("`P:Pair:Left`")[0]).alias("l"), F.col("`P:Pair:Right`")[0].alias("r"), "n")


@query(f"WITH {PADDED} SELECT soldier_id, {_pairs_sql(_DIGITS, _UNIT, 'b')} AS pairs FROM padded")
def factorized_extract(t):
    found = extraction.extract(extraction.adapt_raw(part_text(t)), forms(), dedupe_texts=True)
    return found.select("soldier_id", joined(F.col("`Unit_Term_Digit_Term:Pair`")).alias("pairs"))


@query(f"""WITH {PADDED}, x AS (SELECT {_pairs_sql(_DIGITS, _UNIT, 'b')} AS u, {_single_sql(_ORG)} AS o FROM padded)
SELECT 'Org_Terms' AS "column", round(avg(CASE WHEN o <> '' THEN 1 ELSE 0 END), 6) AS share FROM x
UNION ALL SELECT 'Unit_Term_Digit_Term:Pair', round(avg(CASE WHEN u <> '' THEN 1 ELSE 0 END), 6) FROM x""")
def extraction_summary(t):
    canonical = extraction.canonical_table(part_text(t), forms())
    return extraction.filled_shares(canonical, ["Org_Terms", "Unit_Term_Digit_Term:Pair"]).withColumn("share", F.round("share", 6))


@query("""SELECT doc_id, md5(replace(lower(trim(regexp_replace(replace(replace(replace(replace(replace(replace(text, '“', '"'), '”', '"'), '‘', ''''), '’', ''''), '–', '-'), '—', '-'), '\\s+', ' ', 'g'))), 'ß', 'ss')) AS digest FROM documents""")
def normalize_text(t):
    return t.documents.select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("digest"))


@query("""SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower(trim(s_name)), '[.,]', '', 'g'), '\\s+', ' ', 'g')) AS name,
  array_to_string(list_transform(string_split(replace(s_name, '#', '_'), '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title,
  CASE WHEN regexp_matches(CAST(s_nationkey AS VARCHAR), '^[0-9]+$') THEN CAST(s_nationkey AS VARCHAR) END AS designator,
  CASE WHEN regexp_matches(upper(substring(s_name, 1, 1)), '^\\p{L}$') THEN 'alpha' ELSE 'word' END AS kind,
  CASE WHEN s_nationkey % 3 = 0 THEN 'r' || s_nationkey ELSE '' END AS right_part, CAST(s_nationkey % 10 AS BIGINT) AS stripped FROM supplier""")
def scalar_functions(t):
    pair = F.when(F.col("s_nationkey") % 3 == 0, F.concat(F.lit("a:r"), F.col("s_nationkey").cast("string"))).otherwise("a")
    return t.supplier.select(
        "s_suppkey",
        T.normalize_name(F.col("s_name")).alias("name"),
        T.titleize(F.replace(F.col("s_name"), F.lit("#"), F.lit("_"))).alias("title"),
        T.canon_designator(F.concat(F.lit(" 00"), F.col("s_nationkey").cast("string"))).alias("designator"),
        T.value_type(F.upper(F.substring("s_name", 1, 1))).alias("kind"),
        T.pair_right(pair).alias("right_part"),
        T.strip_ordinal(F.concat((F.col("s_nationkey") % 10).cast("string"), F.lit("th"))).cast("long").alias("stripped"),
    )


@query("""SELECT conv_id, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, CAST(count(*) AS BIGINT) AS n_records FROM conversations GROUP BY conv_id""")
def token_estimates(t):
    return t.conversations.groupBy("conv_id").agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens"), F.count(F.lit(1)).alias("n_records"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_extract(t):
    wrapped = (
        F.when(F.col("event_id") % 4 == 0, F.col("props"))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```\nDone.")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit("The answer is "), F.col("props"), F.lit(" as asked.")))
        .otherwise(F.concat(F.lit("```\n"), F.col("props"), F.lit("\n```")))
    )
    return t.events.select("event_id", F.get_json_object(T.json_from_text(wrapped), "$.k").cast("long").alias("k"))
