r"""Line deduplication by log templates.

Lines are parsed as log messages are: by a tree of fixed depth. The first level is the number
of tokens, the next ones are the leading tokens, and tokens that look variable (those with a
digit, an at sign or ``://``) stand for any value, so a line finds its leaf in constant time.

Within a leaf the template is generalised from all its lines at once, which makes it
independent of their order: a position keeps its token if more than half of the leaf's
(document, line variant) pairs have it there, else it is a variable field. A line belongs to the
template if at least ``similarity`` of its tokens after the leading ones are the template's: the leading
ones are those of the leaf and say nothing. Lines of one masked form are a template of their own.

A leaf may hold several templates. Where the majority gives none, the leaf is split at the place of its most
supported token, a part for each token there that enough pairs have and one for the rest, and each part
is generalised alone. Tokens that a part was chosen by are not enough: one more must be fixed. Leaves
in which a template was found are searched again without its lines, until no template is left.

A template that recurs in at least ``min_docs`` documents is boilerplate: its lines are dropped
everywhere. Token statistics are gathered only for leaves that several forms share and
that occur in enough documents; everything is counted by map-side aggregates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WORD_CLASS, discard, documents, heavy_keys, narrow, saved, skew_join, stored
from .substring_dedup import _signed, _slices

WORD = re.compile(WORD_CLASS)
VARIABLE = re.compile(r"[0-9@]|://")
FIELD = "<*>"
DEPTH, SIMILARITY, MIN_DOCS = 3, 0.5, 5
#: Most tokens of the forms of a leaf that one worker searches.
LEAF_TOKENS = 1 << 18
FORMS = "leaf long, variant long, docs long, ids array<long>, tokens array<long>"
#: Null ids take part under this one.
_NO_ID = -(2**63)


def masked(line: str) -> list[str]:
    """Tokens of a line, variable ones as a field."""
    tokens = WORD.findall(line)
    if VARIABLE.search(line):
        return [FIELD if VARIABLE.search(t) else t for t in tokens]
    return tokens


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _lines(source: DataFrame, depth: int) -> DataFrame:
    """key_id, text_hash, line, leaf and variant of every line with a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in _slices(batch, "text"):
                rows, numbers, leaves, variants = [], [], [], []
                for i, text in enumerate(cut.column("text").to_pylist()):
                    for k, line in enumerate(text.split("\n")):
                        tokens = masked(line)
                        if tokens:
                            rows.append(i)
                            numbers.append(k)
                            leaves.append(_hash(" ".join([str(len(tokens)), *tokens[:depth]])))
                            variants.append(_hash(" ".join(tokens)))
                taken = pa.array(rows, pa.int64())
                arrays = [
                    cut.column("key_id").take(taken),
                    cut.column("text_hash").take(taken),
                    pa.array(numbers, pa.int32()),
                    _signed(np.array(leaves, dtype=np.uint64)),
                    _signed(np.array(variants, dtype=np.uint64)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["key_id", "text_hash", "line", "leaf", "variant"])

    return source.mapInArrow(run, "key_id long, text_hash long, line int, leaf long, variant long")


def _forms(source: DataFrame, wanted: DataFrame, depth: int) -> DataFrame:
    """leaf, variant, docs and ids of the wanted lines, and the hashes of their tokens after the leading ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in _slices(batch, "text"):
                rows, hashes, sizes = [], [], []
                for text, found in zip(cut.column("text").to_pylist(), cut.column("found").to_pylist(), strict=True):
                    lines = text.split("\n")
                    for f in found:
                        tokens = masked(lines[f["line"]])[depth:]
                        rows.append(f)
                        hashes.extend(map(_hash, tokens))
                        sizes.append(len(tokens))
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                arrays = [pa.array([f[x] for f in rows], pa.int64()) for x in ("leaf", "variant", "docs")]
                arrays += [pa.array([f["ids"] for f in rows], pa.list_(pa.int64())), pa.ListArray.from_arrays(ends, _signed(np.array(hashes, dtype=np.uint64)))]
                yield pa.RecordBatch.from_arrays(arrays, ["leaf", "variant", "docs", "ids", "tokens"])

    grouped = wanted.groupBy("key_id", "text_hash").agg(F.collect_list(F.struct("line", "leaf", "variant", "docs", "ids")).alias("found"))
    return source.join(grouped, ["key_id", "text_hash"]).select("text", "found").mapInArrow(run, FORMS)


def leaf_members(tokens: np.ndarray, docs: np.ndarray, ids: list, similarity: float, min_docs: int) -> list[int]:
    """The rows of ``tokens`` (a form each, of one leaf) that belong to a recurring template. ``ids`` has the
    documents of the forms that are in fewer than ``min_docs``."""
    size, found = tokens.shape[1], []
    places = np.unique(tokens, return_inverse=True)[1].reshape(tokens.shape) * size + np.arange(size)
    rest = np.arange(len(tokens))
    while True:
        parts, hits = [(rest, 0)], []
        while parts:
            part, chosen = parts.pop()
            pairs = docs[part].sum()
            if len(part) < 2 or pairs < min_docs:
                continue
            own = places[part]
            keys, at = np.unique(own, return_inverse=True)
            at = at.reshape(own.shape)
            support = np.bincount(at.ravel(), np.repeat(docs[part], size))
            support[support < 2] = 0
            same = (2 * support > pairs)[at].sum(axis=1)
            members = part[(same >= size * similarity) & (same > chosen)]
            if docs[members].sum() >= min_docs and (
                docs[members].max() >= min_docs or len({x for m in members for x in ids[m]}) >= min_docs
            ):
                hits.extend(members.tolist())
                continue
            minor = (2 * support <= pairs) & (support >= min_docs)
            if not minor.any():
                continue
            # the most supported token, at the first of its places
            most = support[minor].max()
            place = (keys[minor & (support == most)] % size).min()
            side = np.where(minor[at[:, place]], at[:, place], -1)
            parts += [(part[side == x], chosen + (x >= 0)) for x in np.unique(side)]
        if not hits:
            return found
        found += hits
        rest = np.setdiff1d(rest, hits)


def _small(forms: DataFrame, similarity: float, min_docs: int) -> DataFrame:
    """leaf and variant of the lines of recurring templates, each leaf by itself in a worker."""

    def solved(leaf: int, variants: list, docs: list, ids: list, tokens: list) -> pa.RecordBatch:
        rows = leaf_members(np.array(tokens), np.array(docs), ids, similarity, min_docs)
        return pa.RecordBatch.from_arrays([pa.array([leaf] * len(rows), pa.int64()), pa.array([variants[k] for k in rows], pa.int64())], ["leaf", "variant"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, held = None, ([], [], [], [])
        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("leaf", "variant", "docs", "ids", "tokens")), strict=True):
                if row[0] != leaf:
                    if leaf is not None:
                        yield solved(leaf, *held)
                    leaf, held = row[0], ([], [], [], [])
                for column, value in zip(held, row[1:], strict=True):
                    column.append(value)
        if leaf is not None:
            yield solved(leaf, *held)

    return forms.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(run, "leaf long, variant long")


def _large(forms: DataFrame, similarity: float, min_docs: int) -> list[DataFrame]:
    """Like ``_small``, for leaves that are too large for one worker: all parts of all leaves a level at a time.

    A pass looks for one template in each part of a leaf and splits the parts without one; the next takes
    the leaves in which some were found again, without the lines found. Tables are stored, not only cut from their lineage:
    a checkpoint keeps the estimated size of its plan, and over many levels the driver would hold numbers of millions of digits."""
    group = ["leaf", "part"]
    found = []
    places = F.posexplode("tokens").alias("place", "token")
    start = stored(forms.select("leaf", "variant", "docs", F.size("tokens").alias("size"), places, F.lit(0).cast("long").alias("part"), F.lit(0).alias("chosen")))
    held = forms.select("leaf", "variant", "ids")
    while True:
        level, hits = start, []
        while True:
            groups = level.where("place = 0").groupBy(*group).agg(F.sum("docs").alias("pairs"), F.count(F.lit(1)).alias("forms"))
            groups = groups.where((F.col("forms") > 1) & (F.col("pairs") >= min_docs)).select(*group, "pairs")
            support = stored(level.groupBy(*group, "place", "token").agg(F.sum("docs").alias("support")).where(F.col("support") > 1).join(groups, group))
            fixed = support.where("2 * support > pairs").select(*group, "place", "token")
            alike = level.join(fixed, [*group, "place", "token"]).groupBy(*group, "variant").agg(
                F.count(F.lit(1)).alias("same"), F.max("size").alias("size"), F.max("chosen").alias("chosen"), F.max("docs").alias("docs")
            )
            members = alike.where((F.col("same") >= F.col("size") * F.lit(similarity)) & (F.col("same") > F.col("chosen")))
            members = stored(members.select(*group, "variant", "docs"))
            # a form in enough documents is enough; the others have few documents each
            often = members.where(F.col("docs") >= min_docs).select(*group).distinct()
            few = members.groupBy(*group).agg(F.sum("docs").alias("pairs"), F.max("docs").alias("most"))
            few = few.where((F.col("pairs") >= min_docs) & (F.col("most") < min_docs)).select(*group)
            counted = members.join(few, group).join(held, ["leaf", "variant"]).select(*group, F.explode("ids").alias("key_id")).distinct()
            counted = counted.groupBy(*group).agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs).select(*group)
            recurring = stored(often.unionByName(counted))
            if recurring.limit(1).count():
                hits.append(stored(members.join(recurring, group).select("leaf", "variant")))
            # the other parts are split at the place of their most supported token
            minor = support.where((2 * F.col("support") <= F.col("pairs")) & (F.col("support") >= min_docs)).join(recurring, group, "left_anti")
            at = stored(minor.groupBy(*group).agg(F.max_by("place", F.struct(F.col("support"), -F.col("place"))).alias("place")))
            split = at.limit(1).count()
            if split:
                marks = minor.join(at, [*group, "place"]).select(*group, "place", "token", F.lit(1).alias("mark"))
                sides = level.join(at, [*group, "place"]).join(marks, [*group, "place", "token"], "left")
                sides = sides.select(
                    *group, "variant", F.xxhash64("part", "place", F.when(F.col("mark") == 1, F.col("token"))).alias("side"), F.coalesce("mark", F.lit(0)).alias("mark")
                )
                columns = ["leaf", "variant", "docs", "size", "place", "token", F.col("side").alias("part"), (F.col("chosen") + F.col("mark")).alias("chosen")]
                after = stored(level.join(sides, [*group, "variant"]).select(*columns))
            for table in (support, members, recurring, at, *([level] if level is not start else [])):
                discard(table)
            if not split:
                break
            level = after
        if not hits:
            discard(start)
            return found
        found += hits
        gone = hits[0]
        for more in hits[1:]:
            gone = gone.unionByName(more)
        rest = stored(start.join(gone.select("leaf").distinct(), "leaf", "left_semi").join(gone, ["leaf", "variant"], "left_anti"))
        discard(start)
        start = rest


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
    similarity: float = SIMILARITY,
    min_docs: int = MIN_DOCS,
    leaf_tokens: int = LEAF_TOKENS,
) -> DataFrame:
    r"""One row per input row: doc_id, n_lines (with a token), n_dropped, kept_text.

    Lines are separated by ``\n``; the text that is kept has the lines that stay, unchanged and in
    order, blank ones included. Null texts count as empty and stay so. Rows with a null id are
    cleaned like others and count as one document together (with rows of the id -2^63, if any); rows repeated with one id count
    as one document. Repeats within one document make no template recur. An empty table gives an
    empty result; other columns are ignored. Leaves whose forms have more than ``leaf_tokens`` tokens are
    searched by joins over all workers, the others in one worker each; which of the two does not change the result.
    """
    source = narrow(docs, id_col, text_col).select(
        "doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("key_id"), F.xxhash64("text").alias("text_hash"), "text"
    )
    # the texts are one side of two joins below, with the same columns: Spark shuffles them once
    lines = stored(_lines(source.select("key_id", "text_hash", "text"), depth))
    # documents of each form of a line, and its first place
    per_doc = lines.groupBy("leaf", "variant", "key_id").agg(F.min(F.struct("text_hash", "line")).alias("at"), F.count(F.lit(1)).alias("n"))
    counts = [F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"), F.min(F.struct("key_id", "at")).alias("place")]
    variants = stored(per_doc.groupBy("leaf", "variant").agg(*counts))
    form = ["leaf", "variant"]
    heavy = saved(heavy_keys(variants, form, lines.count()))
    leaves = variants.groupBy("leaf").agg(F.sum("docs").alias("pairs"), F.count(F.lit(1)).alias("forms"))
    mixed = leaves.where((F.col("forms") > 1) & (F.col("pairs") >= min_docs)).select("leaf")

    # one line of each form in a mixed leaf gives its tokens; forms in few documents keep their ids
    places = stored(variants.join(mixed, "leaf").select(*form, "docs", "place.key_id", "place.at.text_hash", "place.at.line"))
    often = F.broadcast(heavy.join(variants.where(F.col("docs") >= min_docs), form, "left_semi"))
    rare = lines.join(often, form, "left_anti").join(places.where(F.col("docs") < min_docs).select(*form), form)
    rare = rare.groupBy(*form).agg(F.collect_set("key_id").alias("ids"))
    forms = stored(_forms(source, places.join(rare, form, "left"), depth).where(F.size("tokens") > 0))
    large = stored(forms.groupBy("leaf").agg(F.sum(F.size("tokens")).alias("n")).where(F.col("n") > leaf_tokens).select("leaf"))
    dropped = variants.where(F.col("docs") >= min_docs).select(*form)
    if large.limit(1).count():
        for members in _large(stored(forms.join(large, "leaf", "left_semi")), similarity, min_docs):
            dropped = dropped.unionByName(members)
        forms = forms.join(large, "leaf", "left_anti")
    dropped = dropped.unionByName(_small(forms, similarity, min_docs))
    hits = skew_join(lines, saved(dropped.distinct()), form, heavy=heavy).groupBy("key_id", "text_hash").agg(F.collect_set("line").alias("gone"))
    joined = source.join(hits, ["key_id", "text_hash"], "left").select("doc_id", "text", "gone")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in _slices(batch, "text"):
                total, gone_counts, kept = [], [], []
                for text, gone in zip(cut.column("text").to_pylist(), cut.column("gone").to_pylist(), strict=True):
                    parts = text.split("\n")
                    total.append(sum(1 for x in parts if WORD.search(x)))
                    gone_counts.append(len(gone or ()))
                    drop = set(gone or ())
                    kept.append("\n".join(x for k, x in enumerate(parts) if k not in drop) if drop else text)
                arrays = [cut.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone_counts, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_lines", "n_dropped", "kept_text"])

    return joined.mapInArrow(clean, "doc_id long, n_lines long, n_dropped long, kept_text string")


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), raw AS (
  SELECT doc_id, k, parts[k] AS part, regexp_extract_all(parts[k], '[^\x20\x09-\x0D]+') AS words
  FROM d, unnest(generate_series(1, len(parts))) AS t(k)
), line AS (
  SELECT doc_id, k, list_transform(words, lambda w: CASE WHEN regexp_matches(w, '[0-9@]|://') THEN '<*>' ELSE w END) AS m
  FROM raw WHERE len(words) > 0
), keyed AS (
  SELECT doc_id, k, m, len(m) AS size, concat_ws(' ', len(m), array_to_string(m[1:3], ' ')) AS leaf, array_to_string(m, ' ') AS variant FROM line
), variants AS (
  SELECT leaf, variant, any_value(m) AS m, any_value(size) AS size, count(DISTINCT doc_id) AS docs FROM keyed GROUP BY leaf, variant
), mixed AS (
  SELECT leaf, sum(docs) AS pairs FROM variants GROUP BY leaf HAVING count(*) > 1 AND sum(docs) >= 5
), tokens AS (
  SELECT leaf, variant, docs, size, p, m[p] AS token, pairs
  FROM variants JOIN mixed USING (leaf), unnest(generate_series(1, len(m))) AS t(p)
), fixed AS (
  SELECT leaf, p, token FROM tokens GROUP BY leaf, p, token HAVING 2 * sum(docs) > any_value(pairs)
), members AS (
  SELECT leaf, variant FROM tokens JOIN fixed USING (leaf, p, token) GROUP BY leaf, variant HAVING count(*) >= 0.5 * any_value(size)
), recurring AS (
  SELECT leaf FROM keyed JOIN members USING (leaf, variant) GROUP BY leaf HAVING count(DISTINCT doc_id) >= 5
), dropped AS (
  SELECT leaf, variant FROM members WHERE leaf IN (SELECT leaf FROM recurring)
  UNION SELECT leaf, variant FROM variants WHERE docs >= 5
), marked AS (
  SELECT raw.doc_id, raw.k, raw.part, len(raw.words) > 0 AS filled, dropped.leaf IS NOT NULL AS gone
  FROM raw LEFT JOIN keyed USING (doc_id, k) LEFT JOIN dropped USING (leaf, variant)
)
SELECT doc_id, CAST(count(*) FILTER (filled) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       coalesce(string_agg(part, chr(10) ORDER BY k) FILTER (NOT gone), '') AS kept_text
FROM marked GROUP BY doc_id
"""
