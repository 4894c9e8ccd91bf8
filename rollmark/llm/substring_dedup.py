"""Substring deduplication by level-wise doubling.

A passage of ``window`` words that starts in an earlier document is removed from every later
one. Lengths double from a short seed up to the window (13, 25, 50 words); what is repeated
at one length alone is extended to twice that length, and goes on only if it is repeated there:

1. Seeds. Of the stretches of the shortest length inside each window, the one with the
   smallest hash stands for the window. Equal windows have equal stretches, and one row
   stands for the whole run of windows that share a stretch.
2. Doubling. A stretch that occurs in two documents grows to twice its length, to the right
   where the window has room, else to the left. What part of a run grows which way depends
   on the window's words alone, so equal windows keep equal stretches at every level.
3. The window itself, the last doubling. All windows of a run are compared at once, by the
   hash of the run's words (its context): where that is in an earlier document, the run goes.
   Runs that begin a new context of a stretch which other documents share are the edges of
   passages; their windows are compared one by one. No candidates are left after that, as
   any longer repeat is a chain of repeated windows.

Hashes of all lengths come from one prefix sum, so one pass over the texts serves all levels
but the windows at edges; each level is a stored table of the survivors, found by a map-side
aggregate and a join on hash keys, which leaves the rows of hot keys where they are. Hashes are 64 bits, and a window must
agree in the stretches of all levels and in its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WORD_CLASS, claim, discard, documents, narrow, parts, saved, ship, skew_join, stored, text_or_empty

WORD = re.compile(WORD_CLASS)
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    limit = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_HASHES = WordHashes()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any run of words in constant time, from one prefix sum."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        if n:
            np.cumsum(hashes * _powers(_MULTIPLIER, n), out=self.prefix[1:])
        self.down = _powers(_INVERSE, n + 1)

    def at(self, start: np.ndarray, length) -> np.ndarray:
        return mix((self.prefix[start + length] - self.prefix[start]) * self.down[start])


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the number of words of each text."""
    claim("words", _HASHES.clear)
    words = [WORD.findall(t) for t in texts]
    counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(words)), dtype=np.uint64, count=int(counts.sum()))
    return flat, counts


def _slices(batch: pa.RecordBatch, column: str, most: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded amount of text (or one row)."""
    sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(np.nan_to_num(sizes)):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def lengths(window: int, seed: int = 8) -> list[int]:
    """The lengths of the levels, each at most twice the one before: 13, 25 and 50 for 50. The
    first is the smallest of at least ``seed`` words, the last the window, with one between at least."""
    found = [window, (window + 1) // 2]
    while (found[-1] + 1) // 2 >= seed:
        found.append((found[-1] + 1) // 2)
    return found[::-1]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    least, reach = values, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    return np.minimum(least[: len(values) - width + 1], least[width - reach :])


def runs_of_windows(texts: list[str], window: int) -> dict[str, np.ndarray | list[np.ndarray]]:
    """Runs of consecutive windows that have the same stretch at every level: row, first and number
    of windows, the stretches' hashes by level (the window's left out), and the context."""
    levels = lengths(window)
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    none, nothing = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    empty = {"row": none, "first": none, "runs": none, "stretches": [nothing] * (len(levels) - 1), "context": nothing}
    if len(hashes) < window:
        return empty
    rolling = Rolling(hashes)
    size = levels[0]
    width = window - size + 1
    seeds = rolling.at(np.arange(len(hashes) - size + 1), size)
    least = sliding_least(seeds, width)
    doc = np.repeat(np.arange(len(counts)), counts)
    starts = np.flatnonzero(doc[: len(least)] == doc[window - 1 :])
    if not len(starts):
        return empty
    # the first smallest seed is another one if the least value changes, or if it stood at the start that is left behind
    new = np.ones(len(starts), dtype=bool)
    before = starts[1:] - 1
    new[1:] = (starts[:-1] != before) | (least[starts[1:]] != least[before]) | (seeds[before] == least[before])
    at = np.flatnonzero(new)
    first, runs = starts[at], np.diff(np.append(at, len(starts)))
    view = np.lib.stride_tricks.sliding_window_view(seeds, width)
    place = first + np.concatenate([np.argmin(view[first[s : s + 100_000]], axis=1) for s in range(0, len(first), 100_000)])
    stretches = [seeds[place]]
    for longer in levels[1:-1]:
        # windows from ``turn`` on have room to the right of the stretch, those before it to the left
        turn = np.clip(place + longer - window, first, first + runs)
        left, right = np.flatnonzero(turn > first), np.flatnonzero(turn < first + runs)
        place = np.concatenate([place[left] + size - longer, place[right]])
        runs = np.concatenate([(turn - first)[left], (first + runs - turn)[right]])
        first = np.concatenate([first[left], turn[right]])
        stretches = [np.concatenate([found[left], found[right]]) for found in stretches]
        stretches.append(rolling.at(place, longer))
        size = longer
    row = doc[first]
    # where in the run the stretch stands is part of the context, so equal contexts have equal runs
    context = mix(rolling.at(first, runs + window - 1) + (place - first + window).astype(np.uint64) * np.uint64(1_000_003) + runs.astype(np.uint64))
    return {"row": row, "first": first - (ends - counts)[row], "runs": runs, "stretches": stretches, "context": context}


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _level(candidates: DataFrame, stretch: str) -> DataFrame:
    """The candidates (a stored table, deleted here) whose stretch is in two documents or more, without it. Those of
    hot stretches stay where they are."""
    shared = candidates.groupBy(stretch).agg(F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest"), F.count(F.lit(1)).alias("n"))
    shared = stored(shared.where("lowest < highest").select(stretch, "n"))
    survivors = stored(skew_join(candidates, shared, [stretch], candidates.count()).drop(stretch, "n"))
    discard(candidates)
    discard(shared)
    return survivors


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """Runs of repeated windows: doc_id, text_hash, first, runs. ``docs`` has doc_id, text, text_hash."""
    levels = [f"stretch_{length}" for length in lengths(window)[:-1]]

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in _slices(batch, "text"):
                found = runs_of_windows(cut.column("text").to_pylist(), window)
                rows = pa.array(found["row"])
                yield pa.RecordBatch.from_arrays(
                    [
                        cut.column("doc_id").take(rows),
                        cut.column("text_hash").take(rows),
                        pa.array(found["first"].astype(np.int32)),
                        pa.array(found["runs"].astype(np.int16)),
                        *map(_signed, found["stretches"]),
                        _signed(found["context"]),
                    ],
                    ["doc_id", "text_hash", "first", "runs", *levels, "context"],
                )

    keys = "".join(f", {level} long" for level in levels)
    found = docs.mapInArrow(occurrences, f"doc_id long, text_hash long, first int, runs short{keys}, context long")
    # said beforehand, as the joins below would say it of some of the uses only and set them apart
    found = stored(found.where(" AND ".join(f"{key} IS NOT NULL" for key in [*levels, "context"])))
    for level in levels[:-1]:
        found = _level(found, level)
    anchor = levels[-1]
    variants = found.groupBy(anchor, "context").agg(F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest"))
    shared = (
        variants.groupBy(anchor)
        .agg(F.min("lowest").alias("first_doc"), F.max("lowest").alias("last_new"), F.max("highest").alias("last_doc"))
        .where("first_doc < last_doc")
        .select(anchor, "first_doc", "last_new")
    )
    variants = variants.join(shared, anchor).select(anchor, "context", "lowest", "highest", (F.col("first_doc") < F.col("last_new")).alias("open"))
    # an occurrence is settled if its context is in an earlier document; the first of a context
    # is looked at window by window if its stretch begins contexts in more than one document.
    # (no id is above the highest; naming it gives both uses of the table the same columns,
    # so Spark computes and shuffles it once)
    return saved(
        found.join(variants, [anchor, "context"])
        .where(((F.col("doc_id") > F.col("lowest")) | F.col("open")) & (F.col("doc_id") <= F.col("highest")))
        .select("doc_id", "text_hash", "first", "runs", F.col(anchor).alias("anchor"), (F.col("doc_id") > F.col("lowest")).alias("settled"))
    )


def _windows(docs: DataFrame, open_runs: DataFrame, window: int) -> DataFrame:
    """Anchor, window hash and place of every window of the open runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in _slices(batch, "text"):
                hashes, counts = word_hashes(cut.column("text").to_pylist())
                rolling = Rolling(hashes)
                begin = np.cumsum(counts) - counts
                rows, firsts, keys = [], [], []
                for i, places in enumerate(cut.column("places").to_pylist()):
                    for p in places:
                        rows.append(np.full(p["runs"], i))
                        firsts.append(np.arange(p["first"], p["first"] + p["runs"]))
                        keys.append(np.full(p["runs"], p["anchor"], dtype=np.int64))
                row, first = np.concatenate(rows), np.concatenate(firsts)
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        cut.column("doc_id").take(taken),
                        cut.column("text_hash").take(taken),
                        pa.array(first.astype(np.int32)),
                        pa.array(np.concatenate(keys)),
                        _signed(rolling.at(first + begin[row], window)),
                    ],
                    ["doc_id", "text_hash", "first", "anchor", "content"],
                )

    places = open_runs.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "runs", "anchor")).alias("places"))
    joined = docs.join(places, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "places")
    return joined.mapInArrow(run, "doc_id long, text_hash long, first int, anchor long, content long")


def covered(n: int, spans: list[dict] | None, window: int) -> np.ndarray:
    """Which of n words lie in a window of the spans."""
    change = np.zeros(n + 1, dtype=np.int64)
    for s in spans or ():
        change[s["first"]] += 1
        change[min(n, s["first"] + s["runs"] + window - 1)] -= 1
    return np.cumsum(change[:n]) > 0


def find_spans(source: DataFrame, window: int) -> DataFrame:
    """doc_id, text_hash and the repeated windows (first, runs) of each row that has any."""
    if window < 4 or window % 2:
        raise ValueError("window must be even and at least 4")
    runs = repeated_windows(source, window)
    open_windows = _windows(source, runs.where("NOT settled").select("doc_id", "text_hash", "first", "runs", "anchor"), window)
    lowest = open_windows.groupBy("anchor", "content").agg(F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest")).where("lowest < highest")
    late = open_windows.join(lowest, ["anchor", "content"]).where("doc_id > lowest")
    return (
        late.select("doc_id", "text_hash", "first", F.lit(1).cast("short").alias("runs"))
        .unionByName(runs.where("settled").select("doc_id", "text_hash", "first", "runs"))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list(F.struct("first", "runs")).alias("spans"))
    )


def _kept_words(text: str, spans: list[dict] | None, window: int) -> tuple[list[str], list[str]]:
    """All words of a text, and those that no span covers."""
    words = WORD.findall(text)
    if not spans:
        return words, words
    gone = covered(len(words), spans, window).tolist()
    return words, [w for w, g in zip(words, gone, strict=True) if not g]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256; ``with_text`` adds kept_text.

    Words are runs of anything but ASCII white space, compared unchanged. A word goes if a
    window of ``window`` consecutive words that covers it also starts in a row with a smaller id.
    All windows are judged on the input. Repeats within one id never remove anything.

    Null and empty texts have no words. Rows with a null id are returned whole and remove
    nothing. Rows that share an id count as one document for the comparison, and each is
    cleaned by itself. An empty table gives an empty result; other columns are ignored.
    """
    source = narrow(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    # the same filtered table is one side of both joins with texts: Spark shuffles the texts once
    known = source.where("doc_id IS NOT NULL")
    joined = known.join(find_spans(known, window), ["doc_id", "text_hash"], "left").select("doc_id", "text", "spans")
    nameless = source.where("doc_id IS NULL").select("doc_id", "text", F.lit(None).cast(joined.schema["spans"].dataType).alias("spans"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in _slices(batch, "text"):
                total, removed, digests, texts = [], [], [], []
                for text, spans in zip(cut.column("text").to_pylist(), cut.column("spans").to_pylist(), strict=True):
                    words, left = _kept_words(text, spans, window)
                    total.append(len(words))
                    removed.append(len(words) - len(left))
                    kept = " ".join(left)
                    digests.append(hashlib.sha256(kept.encode()).hexdigest())
                    if with_text:
                        texts.append(kept)
                arrays = [cut.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    arrays.append(pa.array(texts, pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return joined.mapInArrow(clean, schema).unionByName(nameless.mapInArrow(clean, schema))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """All rows and columns of ``docs``, the text without the words that substring_dedup removes.
    Texts that lose nothing stay as they are; of others the words left are joined by one space."""
    ship(docs.sparkSession)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # whatever the columns are called
    columns, place = plain.columns, docs.columns.index(text_col)
    own_id = F.col(f"c{docs.columns.index(id_col)}").cast("long")
    own_text = text_or_empty(f"c{place}")
    keyed = plain.withColumns({"cut_id": own_id, "cut_hash": F.xxhash64(own_text)})
    known = keyed.where("cut_id IS NOT NULL")
    spans = find_spans(known.select(F.col("cut_id").alias("doc_id"), own_text.alias("text"), F.col("cut_hash").alias("text_hash")), window)
    spans = spans.select(F.col("doc_id").alias("cut_id"), F.col("text_hash").alias("cut_hash"), F.col("spans").alias("cut_spans"))
    joined = known.join(spans, ["cut_id", "cut_hash"], "left").select(*columns, "cut_spans")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in parts(batch):
                texts = []
                for text, found in zip(cut.column(place).to_pylist(), cut.column(len(columns)).to_pylist(), strict=True):
                    if found:
                        words, left = _kept_words(text, found, window)
                        text = " ".join(left) if len(left) < len(words) else text
                    texts.append(text)
                arrays = [pa.array(texts, pa.string()) if k == place else cut.column(k) for k in range(len(columns))]
                yield pa.RecordBatch.from_arrays(arrays, columns)

    return joined.mapInArrow(clean, plain.schema).unionByName(plain.where(own_id.isNull())).toDF(*docs.columns)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) AS h
  FROM d, unnest(generate_series(1, len(w) - 49)) AS t(s) WHERE len(w) >= 50
), low AS (
  SELECT h, min(doc_id) AS lowest FROM win GROUP BY h
), hit AS (
  SELECT doc_id, s FROM win JOIN low USING (h) WHERE doc_id > lowest
), gone AS (
  SELECT DISTINCT doc_id, p FROM hit, unnest(generate_series(s, s + 49)) AS t(p)
), gone_list AS (
  SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id
), words AS (
  SELECT d.doc_id, t.p, w[t.p] AS word FROM d, unnest(generate_series(1, len(w))) AS t(p)
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS kept
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p WHERE gone.p IS NULL GROUP BY words.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN gone_list g USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
