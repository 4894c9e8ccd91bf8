"""Quality classification from weak labels.

Eight heuristic labellers look at each whole text and vote good, bad or nothing. The votes of
all documents are counted by pattern (at most 3^8 rows, whatever the size of the corpus), and
expectation-maximisation over these counts estimates how often each labeller votes which way
on good and on bad documents, and from that the probability that a pattern is good. These
posteriors label a bounded sample, on which a linear scorer over hashed word shapes and
hashed measures is fitted; the scorer judges every document. No human labels are used.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import claim, documents, narrow, parts
from .substring_dedup import _slices

BUCKETS = 1 << 14
GOOD, BAD, NONE = 2, 0, 1

#: Frequent function words of English, French, German and Spanish (fixed values).
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for it was on with as be at by this are from or an not "
    "de la le les et des en un une du que est pour dans qui sur au par plus pas avec "
    "der die und den von zu das mit sich ist im dem nicht ein eine auf für als auch "
    "el los las del se por con una su para es al lo como más pero o y".split()
)
SYMBOLS = re.compile(r"[#*$%&|<>{}=\\^~@]+")
_EDGE = ".,;:!?\"'()[]"


def measure(text: str) -> tuple[list[str], dict[str, float]]:
    """The words of a whole text, and its measures."""
    words = text.split()
    n = len(words)
    if not n:
        return words, {}
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    chars = sum(len(w) * c for w, c in counts.items())
    symbols = sum(map(len, SYMBOLS.findall(text)))
    frequent = sum(c for w, c in counts.items() if w in FUNCTION_WORDS or w.strip(_EDGE).lower() in FUNCTION_WORDS)
    upper = sum(c for w, c in counts.items() if w.isupper() and len(w) > 1)
    pairs = len(set(zip(words, words[1:], strict=False)))
    ends = sum(x.rstrip()[-1] in ".!?:;\"')»" for x in lines)
    return words, {
        "symbols": symbols / chars,
        "upper": upper / n,
        "frequent": frequent / n,
        "pairs": pairs / max(1, n - 1) if n > 1 else 1.0,
        "lines": len(set(lines)) / len(lines),
        "length": chars / n,
        "top": max(counts.values()) / n,
        "ends": ends / len(lines),
        "bang": text.count("!") / n,
        "words": float(n),
    }


def votes(m: dict[str, float]) -> list[int]:
    """Votes of the labellers; a text without words gets a bad vote from each."""
    if not m:
        return [BAD] * 8
    long = m["words"] >= 20

    def vote(good: bool, bad: bool) -> int:
        return BAD if bad else GOOD if good else NONE

    return [
        vote(m["symbols"] < 0.01, m["symbols"] > 0.08),
        vote(m["upper"] < 0.05, long and m["upper"] > 0.5),
        vote(m["frequent"] > 0.12, long and m["frequent"] < 0.02),
        vote(m["pairs"] > 0.9, long and m["pairs"] < 0.5),
        vote(m["lines"] > 0.95, m["lines"] < 0.5),
        vote(2.5 <= m["length"] <= 12, m["length"] > 25 or m["length"] < 1.5),
        vote(m["top"] < 0.15, long and m["top"] > 0.4),
        vote(m["ends"] > 0.6 and m["bang"] < 0.1, long and (m["bang"] > 0.5)),
    ]


N_LABELLERS = 8


#: What a labeller is believed to vote (bad, nothing, good) on bad and on good texts before any
#: votes are counted, and the weight of this belief as a share of all texts. It keeps a labeller's
#: bad votes on the bad side, and makes good texts be found good when few bad ones are seen.
PRIOR_RATES = ((0.3, 0.2, 0.5), (0.01, 0.19, 0.8))
PRIOR_SHARE = 0.02


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, share: float = PRIOR_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of "good" for each vote pattern, and the labellers' vote rates (class x labeller x vote).

    It starts from votes in which one bad vote outweighs three good ones, since labellers vote
    bad for a reason and good for want of one."""
    lean = (patterns == GOOD).sum(axis=1) - 4.0 * (patterns == BAD).sum(axis=1)
    post = 1 / (1 + np.exp(-np.clip(lean, -10, 10)))
    onehot = np.stack([patterns == v for v in range(3)], axis=2).astype(np.float64)
    rates = np.zeros((2, patterns.shape[1], 3))
    belief = share * counts.sum() * np.array(PRIOR_RATES)
    for _ in range(rounds):
        for c, weight in ((0, counts * (1 - post)), (1, counts * post)):
            mass = np.einsum("p,plv->lv", weight, onehot) + belief[c] + 1.0  # one vote of each kind seen beforehand
            rates[c] = mass / mass.sum(axis=1, keepdims=True)
        prior = np.clip((counts * post).sum() / counts.sum(), 0.01, 0.99)
        score = np.einsum("plv,lv->p", onehot, np.log(rates[1]) - np.log(rates[0])) + np.log(prior / (1 - prior))
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        moved, post = np.abs(new - post).max(), new
        if moved < 1e-9:
            break
    return post, rates


_SHAPE = ((re.compile(r"[^\W\d_]"), "x"), (re.compile(r"\d"), "0"))


class ShapeBuckets(dict):
    """Hash bucket of the shape of each word; a bounded number of words is kept."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        case = "U" if word.isupper() and len(word) > 1 else "T" if word[:1].isupper() else "l"
        shape = word
        for pattern, mark in _SHAPE:
            shape = pattern.sub(mark, shape)
        tail = shape.lstrip("x0")[:4]
        value = self[word] = zlib.crc32(f"{case}{min(len(word), 16)}|{tail}".encode("utf-8", "replace")) % BUCKETS
        return value


_SHAPES = ShapeBuckets()
#: Steps of each measure that become a feature of their own.
BINS = {
    "symbols": (0.005, 0.02, 0.05, 0.1, 0.2),
    "upper": (0.02, 0.1, 0.3, 0.6),
    "frequent": (0.02, 0.05, 0.1, 0.2, 0.3),
    "pairs": (0.1, 0.3, 0.5, 0.7, 0.9),
    "lines": (0.3, 0.5, 0.8, 0.95),
    "length": (1.5, 2.5, 4, 8, 12, 25),
    "top": (0.1, 0.2, 0.4, 0.7),
    "ends": (0.1, 0.3, 0.6),
    "bang": (0.1, 0.3, 0.5),
}


def features(words: list[str], m: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: shares of word shapes, and one bucket for the step of each measure."""
    if not words:
        return np.array([zlib.crc32(b"empty") % BUCKETS]), np.ones(1)
    ids, counts = np.unique(np.fromiter(map(_SHAPES.__getitem__, words), dtype=np.int64, count=len(words)), return_counts=True)
    steps = [zlib.crc32(f"{k}>{sum(m[k] > x for x in bins)}".encode()) % BUCKETS for k, bins in BINS.items()]
    return np.concatenate([ids, steps]), np.concatenate([counts / len(words), np.ones(len(steps))])


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], steps: int = 300, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer for soft labels."""
    if not rows:
        return np.zeros(BUCKETS), 5.0
    r = np.repeat(np.arange(len(rows)), [len(x[0]) for x in rows])
    c, v = np.concatenate([x[0] for x in rows]), np.concatenate([x[1] for x in rows])
    y = np.array([x[2] for x in rows])
    w, bias = np.zeros(BUCKETS), float(np.log((y.mean() + 0.01) / (1.01 - y.mean())))
    mw, vw, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(r, weights=w[c] * v, minlength=len(rows)) + bias
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        gw, gb = np.bincount(c, weights=d[r] * v, minlength=BUCKETS) + decay * w / BUCKETS, d.sum()
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.05 * (mw / a) / (np.sqrt(vw / b) + 1e-9)
        bias -= 0.05 * (mb / a) / (np.sqrt(vb / b) + 1e-9)
    return w, float(bias)


def _code(m: dict[str, float]) -> int:
    return int("".join(map(str, votes(m))), 3)


class QualityModel:
    """Posterior of each vote pattern, and the weights of the scorer."""

    def __init__(self, posterior: dict[int, float], weights: np.ndarray, bias: float):
        self.posterior, self.weights, self.bias = posterior, weights, bias

    def judge(self, text: str) -> tuple[float, float]:
        """Posterior of the votes for a text (0 for a pattern never seen), and its score."""
        words, m = measure(text)
        weak = self.posterior.get(_code(m), 0.0)
        if not words:
            return weak, 0.0
        i, v = features(words, m)
        return weak, float(1 / (1 + np.exp(-np.clip(self.weights[i] @ v + self.bias, -30, 30))))


def fit_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 8000) -> QualityModel:
    """Estimate the labellers on all documents, and fit the scorer on at most ``sample_rows`` of them."""
    source = narrow(docs, id_col, text_col)
    spread = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 30))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in _slices(batch, "text"):
                codes = Counter(_code(measure(t)[1]) for t in cut.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(codes.keys(), pa.int32()), pa.array(codes.values(), pa.int64())], ["pattern", "n"])

    counted = source.select("text").mapInArrow(vote, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    if not counted:
        return QualityModel({}, np.zeros(BUCKETS), 5.0)
    codes = np.array([r["pattern"] for r in counted], dtype=np.int64)
    patterns = np.stack([codes // 3**k % 3 for k in range(N_LABELLERS - 1, -1, -1)], axis=1)
    counts = np.array([r["n"] for r in counted], dtype=np.float64)
    posterior = dict(zip(codes.tolist(), expectation_maximisation(patterns, counts)[0].tolist(), strict=True))
    total = counts.sum()
    below = int((1 << 30) * 0.9 * sample_rows / total) if total > sample_rows else 1 << 30

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values, labels = [], [], []
            for text in batch.column("text").to_pylist():
                words, m = measure(text)
                i, v = features(words, m)
                ids.append(i.astype(np.int32))
                values.append(v)
                labels.append(posterior[_code(m)])
            arrays = [pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64())), pa.array(labels, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["ids", "vals", "label"])

    # copies of a text share its hash: each distinct text counts once
    taken = source.where(spread < below).select("text").distinct().mapInArrow(sample, "ids array<int>, vals array<double>, label double")
    rows = sorted((r["ids"], r["vals"], r["label"]) for r in taken.limit(sample_rows).collect())
    return QualityModel(posterior, *fit_scorer([(np.array(i, dtype=np.int64), np.array(v), y) for i, v, y in rows]))


def quality_classifier(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = 8000,
    least: float = 0.5,
    model: QualityModel | None = None,
) -> DataFrame:
    """One row per input row: doc_id, weak_score (posterior of its votes), score, kept.

    A row is kept if the scorer gives it at least ``least``. Without a ``model`` one is fitted on
    the documents; the scorer's sample is chosen by a hash of the text. Null and empty texts,
    and texts of white space, have no words: each labeller votes bad and the row is rejected with
    score 0. Null ids and repeated rows are judged like any other. An empty table gives an
    empty result; other columns are ignored.
    """
    model = model or fit_quality(docs, id_col, text_col, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights and 3^8 patterns at most

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = shared.value
        claim("shapes", _SHAPES.clear)
        for batch in batches:
            for cut in _slices(batch, "text"):
                judged = [tool.judge(t) for t in cut.column("text").to_pylist()]
                weak, scores = [x[0] for x in judged], [x[1] for x in judged]
                arrays = [cut.column("doc_id"), pa.array(weak, pa.float64()), pa.array(scores, pa.float64()), pa.array([s >= least for s in scores], pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "weak_score", "score", "kept"])

    return narrow(docs, id_col, text_col).mapInArrow(judge, "doc_id long, weak_score double, score double, kept boolean")


def keep_good(docs: DataFrame, text_col: str = "text", sample_rows: int = 8000, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that quality_classifier keeps, with all their columns and no shuffle."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # whatever the columns are called
    place = docs.columns.index(text_col)
    texts = plain.select(F.lit(0).alias("doc_id"), F.col(f"c{place}").alias("text"))
    model = fit_quality(texts, "doc_id", "text", sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = shared.value
        claim("shapes", _SHAPES.clear)
        for batch in batches:
            for cut in parts(batch):
                kept = [tool.judge(t or "")[1] >= least for t in cut.column(place).to_pylist()]
                yield cut.filter(pa.array(kept, pa.bool_()))

    return plain.mapInArrow(judge, plain.schema).toDF(*docs.columns)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(documents(spark, sf_dir))
