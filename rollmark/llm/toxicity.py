"""Toxicity scores by a counterfactually regularised linear classifier.

Features of a sentence are the hashed letters-only words and their leading characters (four
to six of them). A document scores as its most toxic sentence does, so a long text is not toxic
for being long. The model is a logistic regression over the features that stand out in toxic
documents, fitted on the strongest sentence of each document of a bounded sample, a few times
over, because the strongest sentence depends on the model.

Every sampled sentence that names a group is paired with copies in which the name is swapped
for the other names of its set. For sets that no sampled sentence names, such sentences are made: in
sentences of labelled documents the last word becomes a name, and those of label 0 are learned from
as neutral mentions. The loss adds ``penalty`` times the squared difference of the
logits of a sentence and its copies, so the model cannot lean on which group is named.

The driver sees features, never texts: first the buckets that stand out, then the sentences of the sample as
lists of these buckets.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, narrow, quoted, saved
from .language_id import remainder
from .substring_dedup import _slices

BUCKETS = 1 << 20
WORDS = re.compile(r"[^\W\d_]+")
SENTENCES = re.compile(r"[.!?\n]+")

#: Sets of names of groups that may stand for one another in a sentence.
IDENTITY_SETS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "citizens", "locals"),
    ("old", "young", "elderly"),
    ("blind", "deaf", "disabled"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)


def word_features(word: str) -> list[int]:
    """Buckets of a lower-case word: itself and its leading characters."""
    keys = ["w" + word] + ["p" + word[:k] for k in (4, 5, 6) if len(word) > k]
    if len(word) in (4, 5, 6):
        keys.append("p" + word)
    return [zlib.crc32(k.encode("utf-8", "replace")) % BUCKETS for k in keys]


def sentences(text: str) -> list[list[str]]:
    found = (WORDS.findall(s) for s in SENTENCES.split(text.lower()))
    return [words for words in found if words]


def swaps(words: list[str], sets=IDENTITY_SETS) -> list[list[str]]:
    """Copies of a sentence in which each named group is another one of its set."""
    out = []
    for names in sets:
        if not set(names) & set(words):
            continue
        for shift in range(1, len(names)):
            change = {n: names[(i + shift) % len(names)] for i, n in enumerate(names)}
            out.append([change.get(w, w) for w in words])
    return out


class ToxicityModel:
    """Weights of the buckets that count, and a bias. Words sum up, once each, in a sentence.

    ``report`` tells how the model was fitted: ``swapped`` and ``made`` pairs, and the mean ``gap`` of
    their logits."""

    def __init__(self, weights: dict[int, float], bias: float, report: dict[str, float] | None = None):
        self.weights, self.bias, self.report = weights, bias, report or {}
        self._words: dict[str, float] = {}

    def word(self, word: str) -> float:
        value = self._words.get(word)
        if value is None:
            if len(self._words) >= 400_000:
                self._words.clear()
            value = self._words[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return value

    def logit(self, words: list[str]) -> float:
        return self.bias + sum(map(self.word, set(words)))

    def score(self, text: str) -> float:
        """Probability of label 1 for a whole text; that of the bias for one without words."""
        text = text.lower()
        if any(map(self.word, set(WORDS.findall(text)))):
            best = max(self.logit(words) for words in sentences(text))
        else:
            best = self.bias
        return float(1 / (1 + np.exp(-np.clip(best, -30, 30))))


#: What a bucket must show to count: how far it stands out, in how many toxic documents it is, and how many
#: times as frequent it is in them as in others.
LEAST_Z, LEAST_SEEN, LEAST_RATIO = 4, 4, 4
#: Sentences of either label in which names are put, for each set of names that the sample lacks.
MADE = 16


class Sentences:
    """Sentences as sorted lists of columns: those of the buckets in ``chosen`` and of all names in ``sets``."""

    def __init__(self, chosen: list[int], sets=IDENTITY_SETS):
        named = {f for names in sets for name in names for f in word_features(name)}
        self.buckets = [*chosen, *sorted(named - set(chosen))]
        self.telling = len(chosen)
        self.place = {f: i for i, f in enumerate(self.buckets)}
        self.sets = sets
        self._words: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        found = self._words.get(word)
        if found is None:
            if len(self._words) >= 200_000:
                self._words.clear()
            found = self._words[word] = [self.place[f] for f in word_features(word) if f in self.place]
        return found

    def row(self, words: list[str]) -> list[int]:
        return sorted(c for w in set(words) for c in self.word(w))

    def document(self, text: str) -> tuple[list[list[int]], list[list[int]], list[int], list[int]]:
        """Distinct sentences with a column, swapped pairs (left, right, left, ...), the sets that are
        named, and the first longer sentence without its last word."""
        split = sentences(text)
        bag = sorted({tuple(r) for r in map(self.row, split) if r})
        pairs, named = set(), set()
        for words in split:
            here = set(words)
            for i, names in enumerate(self.sets):
                if not here.isdisjoint(names):
                    named.add(i)
                    pairs |= {(tuple(self.row(words)), tuple(self.row(other))) for other in swaps(words, (names,))}
        frame = next((words for words in split if len(words) >= 4), [])
        return [list(r) for r in bag], [list(r) for pair in sorted(pairs) for r in pair], sorted(named), self.row(frame[:-1])


def _sparse(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([c for r in rows for c in r], dtype=np.int64)


def solve(
    known: Sentences,
    documents: list[tuple[list[list[int]], list[list[int]], list[int], list[int]]],
    labels: list[int],
    penalty: float = 1.0,
    decay: float = 1e-3,
    rounds: int = 4,
    steps: int = 300,
) -> ToxicityModel:
    """Fit on documents as ``Sentences.document`` gives them; without both labels the model knows no feature."""
    if not labels or min(labels) == max(labels):
        return ToxicityModel({}, 0.0 if not labels else (4.0 if labels[0] else -4.0))
    bags = [d[0] or [[]] for d in documents]
    pairs = [(d[1][i], d[1][i + 1]) for d in documents for i in range(0, len(d[1]), 2)]
    swapped, targets = len(pairs), list(labels)
    absent = [names for i, names in enumerate(known.sets) if not any(i in d[2] for d in documents)]
    frames = [[d[3] for d, y in zip(documents, labels, strict=True) if y == label][:MADE] for label in (0, 1)]
    for names in absent:
        for label in (0, 1):
            for turn, frame in enumerate(frames[label]):
                rows = [sorted({*frame, *known.row([name])}) for name in names]
                pairs += [(rows[i], rows[i - 1]) for i in range(len(rows))]
                if label == 0:
                    bags.append([rows[turn % len(rows)]])
                    targets.append(0)
    left, right = _sparse([p[0] for p in pairs]), _sparse([p[1] for p in pairs])
    width = len(known.buckets)

    def gaps(w: np.ndarray) -> np.ndarray:
        return np.bincount(left[0], weights=w[left[1]], minlength=len(pairs)) - np.bincount(right[0], weights=w[right[1]], minlength=len(pairs))

    y = np.array(targets, dtype=np.float64)
    balance = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w, bias = np.zeros(width), -2.0
    w[: known.telling] = 1.0
    for _ in range(rounds):
        r, c = _sparse([max(bag, key=lambda row: w[row].sum()) for bag in bags])
        mw, vw, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
        for t in range(1, steps + 1):
            logit = np.bincount(r, weights=w[c], minlength=len(y)) + bias
            residual = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * balance
            gw = np.bincount(c, weights=residual[r], minlength=width) + decay * w / max(1, width) ** 0.5
            gb = residual.sum()
            if pairs:
                gap = gaps(w) / len(pairs)
                gw += 2 * penalty * (np.bincount(left[1], weights=gap[left[0]], minlength=width) - np.bincount(right[1], weights=gap[right[0]], minlength=width))
            mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw * gw
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            fix1, fix2 = 1 - 0.9**t, 1 - 0.999**t
            w = w - 0.05 * (mw / fix1) / (np.sqrt(vw / fix2) + 1e-8)
            bias = bias - 0.05 * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-8)
    report = {"swapped": swapped, "made": len(pairs) - swapped, "gap": float(np.abs(gaps(w)).mean()) if pairs else 0.0}
    return ToxicityModel({int(f): float(x) for f, x in zip(known.buckets, w, strict=True) if abs(x) > 1e-3}, float(bias), report)


def fit_toxicity(rows: DataFrame, penalty: float = 1.0, sets=IDENTITY_SETS) -> ToxicityModel:
    """Fit on all ``rows`` (doc_id, text, label); they are read twice and should be a stored sample."""
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return solve(Sentences([], sets), [], list(sizes))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in _slices(batch, "text"):
                total = np.zeros((2, BUCKETS), dtype=np.int64)
                for text, label in zip(cut.column("text").to_pylist(), cut.column("label").to_pylist(), strict=True):
                    total[label, list({f for w in set(WORDS.findall(text.lower())) for f in word_features(w)})] += 1
                used = np.flatnonzero(total.any(axis=0))
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[1, used]), pa.array(total[0, used])], ["bucket", "bad", "fine"])

    n1, n0 = float(sizes[1]), float(sizes[0])
    counted = rows.select("text", "label").mapInArrow(seen, "bucket long, bad long, fine long").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine"))
    pooled = (F.col("bad") + F.col("fine") + 1) / F.lit(n0 + n1 + 2)
    z = (F.col("bad") / n1 - F.col("fine") / n0) / F.sqrt(pooled * (1 - pooled) * (1 / n0 + 1 / n1))
    telling = counted.where((z > LEAST_Z) & (F.col("bad") >= LEAST_SEEN) & (F.col("bad") / n1 > LEAST_RATIO * F.col("fine") / n0))
    known = Sentences(sorted(r["bucket"] for r in telling.select("bucket").collect()), sets)  # BUCKETS at most
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, lists = shared.value, pa.list_(pa.list_(pa.int32()))
        for batch in batches:
            for cut in _slices(batch, "text"):
                found = [tool.document(t) for t in cut.column("text").to_pylist()]
                columns = list(zip(*found, strict=True))
                kinds = (lists, lists, pa.list_(pa.int32()), pa.list_(pa.int32()))
                arrays = [cut.column("doc_id"), cut.column("label"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "label", "bag", "pairs", "named", "frame"])

    schema = "doc_id long, label int, bag array<array<int>>, pairs array<array<int>>, named array<int>, frame array<int>"
    found = sorted(rows.select("doc_id", "text", "label").mapInArrow(features, schema).collect(), key=lambda r: r["doc_id"])
    return solve(known, [(r["bag"], r["pairs"], r["named"], r["frame"]) for r in found], [r["label"] for r in found], penalty)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    modulus: int = 5,
    held: int = 0,
    sample_rows: int = 6000,
    penalty: float = 1.0,
    model: ToxicityModel | None = None,
    sets: tuple = IDENTITY_SETS,
) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    ``sets`` names the groups that may stand for one another. Without a ``model`` one is fitted on at most ``sample_rows`` labelled rows that are not held
    out, as many of either label as there are up to half of that, chosen by a hash of the id.
    A null or empty text has the score of a text without any telling word. Null labels are
    left out; of an id with several labels the highest counts. Rows with a null id are held
    out. An empty table gives an empty result; other columns are ignored.
    """
    if model is None:
        known = labels.select(quoted(id_col).cast("long").alias("doc_id"), quoted(label_col).cast("int").alias("label"))
        known = known.where("label IN (0, 1) AND doc_id IS NOT NULL").where(remainder(F.col("doc_id"), modulus) != held)
        known = saved(known.groupBy("doc_id").agg(F.max("label").alias("label")))
        counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        picked = []
        spread = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 30))
        for label, n in sorted(counts.items()):
            share = 1.0 if n <= sample_rows // 2 else 0.9 * (sample_rows // 2) / n
            picked.append((F.col("label") == label) & (spread < int((1 << 30) * share)))
        chosen = known.where(picked[0] if len(picked) < 2 else picked[0] | picked[1]) if picked else known
        source = narrow(docs, id_col, text_col)
        rows = source.join(F.broadcast(chosen.limit(sample_rows)), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
        model = fit_toxicity(saved(rows), penalty, sets)
    source = narrow(docs, id_col, text_col).withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), modulus), F.lit(held)) == held)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # at most one weight per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = ToxicityModel(*shared.value)
        for batch in batches:
            for cut in _slices(batch, "text"):
                scores = [tool.score(t) for t in cut.column("text").to_pylist()]
                arrays = [cut.column("doc_id"), cut.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted"])

    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
