"""Language identification by a byte convolutional network, trained in numpy.

Bytes are folded into 64 classes (letters without case, the bytes of multi-byte characters,
digits, space, other). Filters of width two, three and four run over fixed-length windows;
each filter's largest response in a window feeds a softmax over languages. For a trained
network the filters become tables: a response is the sum of one or two table rows for pairs of
neighbouring classes, so a whole batch of windows is a few gathers and one maximum.

Every window of a text counts, weighted by its letters. The network is fitted by Adam on a
bounded sample: at most ``sample_docs`` texts per language, from each of which at most
``sample_windows`` windows are taken, spread over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, narrow, quoted, ship
from .substring_dedup import _slices

CLASSES, PAD = 64, 0
WIDTHS = (2, 3, 4)
WINDOW = 256


def byte_classes() -> np.ndarray:
    """The class of each byte: 0 padding, 1 white space, 2 digit, 3 other ASCII, 4-29 letters, 30-63 the rest."""
    table = np.full(256, 3, dtype=np.uint8)
    for b in range(256):
        if b in (9, 10, 11, 12, 13, 32):
            table[b] = 1
        elif 48 <= b <= 57:
            table[b] = 2
        elif chr(b).isascii() and chr(b).isalpha():
            table[b] = 4 + ord(chr(b).lower()) - 97
        elif b >= 192:
            table[b] = 30 + (b - 192) % 2  # lead bytes
        elif b >= 128:
            table[b] = 32 + b % 32  # continuation bytes; the case bit of Latin letters is folded
    return table


TABLE = byte_classes()


def windows(texts: list[str], length: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Class windows (n x length, padded) of all texts, and the text of each window."""
    blobs = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([max(1, -(-len(b) // length)) for b in blobs])
    out = np.zeros((int(sizes.sum()), length), dtype=np.uint8)
    flat, at = out.reshape(-1), 0
    for blob, size in zip(blobs, sizes.tolist(), strict=True):
        flat[at : at + len(blob)] = TABLE[np.frombuffer(blob, dtype=np.uint8)]
        at += size * length
    return out, np.repeat(np.arange(len(texts)), sizes)


class ByteNetwork:
    """Filters W[width][offset, class, filter], bias b[width], softmax V, c."""

    def __init__(self, languages: list[str], filters: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.filters = filters
        self.W = {w: rng.normal(0, 0.3, (w, CLASSES, filters)).astype(np.float32) for w in WIDTHS}
        self.b = {w: np.zeros(filters, np.float32) for w in WIDTHS}
        self.V = rng.normal(0, 0.1, (filters * len(WIDTHS), len(languages))).astype(np.float32)
        self.c = np.zeros(len(languages), np.float32)

    def _tables(self):
        out = {}
        for w in WIDTHS:
            weights = self.W[w]
            pair = (weights[0][:, None, :] + weights[1][None, :, :]).reshape(CLASSES * CLASSES, -1)
            if w == 3:
                rest = np.repeat(weights[2][None], 1, axis=0).reshape(CLASSES, -1)
            elif w == 4:
                rest = (weights[2][:, None, :] + weights[3][None, :, :]).reshape(CLASSES * CLASSES, -1)
            else:
                rest = None
            out[w] = (np.ascontiguousarray(pair), rest)
        return out

    def pooled(self, x: np.ndarray, step: int = 128) -> np.ndarray:
        """Largest response of each filter in each window, rectified."""
        tables = self._tables()
        out = np.empty((len(x), self.filters * len(WIDTHS)), np.float32)
        for s in range(0, len(x), step):
            part = x[s : s + step]
            pairs = part[:, :-1].astype(np.int32) * CLASSES + part[:, 1:]
            for j, w in enumerate(WIDTHS):
                head, rest = tables[w]
                z = head.take(pairs[:, : part.shape[1] - w + 1], axis=0)
                if w == 3:
                    z += rest.take(part[:, 2:], axis=0)
                elif w == 4:
                    z += rest.take(pairs[:, 2:], axis=0)
                out[s : s + step, j * self.filters : (j + 1) * self.filters] = np.maximum(z.max(axis=1) + self.b[w], 0)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.V + self.c
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 11) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        params = [self.V, self.c, *self.W.values(), *self.b.values()]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        weight = (len(y) / (len(self.languages) * np.maximum(np.bincount(y, minlength=len(self.languages)), 1))).astype(np.float32)
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(x), batch):
                i = order[s : s + batch]
                part, target = x[i], y[i]
                tables = self._tables()
                pairs = part[:, :-1].astype(np.int32) * CLASSES + part[:, 1:]
                hidden, places = [], []
                for w in WIDTHS:
                    head, rest = tables[w]
                    z = head.take(pairs[:, : part.shape[1] - w + 1], axis=0)
                    if w == 3:
                        z += rest.take(part[:, 2:], axis=0)
                    elif w == 4:
                        z += rest.take(pairs[:, 2:], axis=0)
                    at = z.argmax(axis=1)
                    places.append(at)
                    hidden.append(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0] + self.b[w])
                raw = np.concatenate(hidden, axis=1)
                h = np.maximum(raw, 0)
                z = h @ self.V + self.c
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(i)), target] -= 1
                p *= (weight[target] / len(i))[:, None]
                grads = [h.T @ p + 1e-4 * self.V, p.sum(axis=0)]
                back = (p @ self.V.T) * (raw > 0)
                by_width, by_bias = [], []
                for j, w in enumerate(WIDTHS):
                    g = back[:, j * self.filters : (j + 1) * self.filters]
                    grad = np.zeros_like(self.W[w])
                    rows = np.arange(len(i))[:, None]
                    for k in range(w):
                        np.add.at(grad[k], (part[rows, places[j] + k], np.arange(self.filters)[None, :]), g)
                    by_width.append(grad + 1e-5 * self.W[w])
                    by_bias.append(g.sum(axis=0))
                t += 1
                for param, grad, (m, v) in zip(params, [*grads, *by_width, *by_bias], moments, strict=True):
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    param -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return self


def predict(network: ByteNetwork, texts: list[str]) -> tuple[list[str], list[float]]:
    """Language and mean probability of whole texts; ``und`` and 0 for texts without a letter."""
    x, doc = windows(texts)
    letters = (x >= 4).sum(axis=1).astype(np.float64)
    p = network.probabilities(x)
    n, m = len(texts), len(network.languages)
    sums = np.stack([np.bincount(doc, weights=letters * p[:, j], minlength=n) for j in range(m)], axis=1)
    total = np.bincount(doc, weights=letters, minlength=n)
    mean = sums / np.maximum(total, 1)[:, None]
    best = mean.argmax(axis=1)
    named, scores = [], []
    for i, text in enumerate(texts):
        has_letter = total[i] > 0 and (text.isascii() or any(map(str.isalpha, text)))
        named.append(network.languages[best[i]] if has_letter else "und")
        scores.append(float(min(1.0, mean[i, best[i]])) if has_letter else 0.0)
    return named, scores


def remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(id_column.cast("string").cast("binary")) % modulus


def train(docs: DataFrame, text_col: str, lang_col: str, sample_docs: int = 600, sample_windows: int = 4, filters: int = 8) -> ByteNetwork | None:
    """A network fitted on at most ``sample_docs`` texts per language of the labelled rows, chosen by
    a hash of the text; None if there are no labelled rows."""
    rows = docs.select(quoted(lang_col).cast("string").alias("lang"), quoted(text_col).cast("string").alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    spread = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    wanted = None
    for lang in languages:
        part = (F.col("lang") == lang) & (spread < int((1 << 30) * min(1.0, 0.8 * sample_docs / counts[lang] if counts[lang] > sample_docs else 1.0)))
        wanted = part if wanted is None else wanted | part
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _slices(batch, "text"):
                x, doc = windows(piece.column("text").to_pylist())
                letters = (x >= 4).sum(axis=1)
                langs = piece.column("lang").to_pylist()
                keep = []
                for i in range(len(langs)):
                    own = np.flatnonzero((doc == i) & (letters >= 16))
                    keep.extend(own[np.linspace(0, len(own) - 1, min(sample_windows, len(own))).astype(int)].tolist() if len(own) else [])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([langs[doc[k]] for k in keep], pa.string()), pa.array([x[k].tobytes() for k in keep], pa.binary())], ["lang", "window"]
                )

    # copies of a text share its hash: each distinct text counts once
    found = sorted((r["lang"], bytes(r["window"])) for r in rows.where(wanted).distinct().mapInArrow(cut, "lang string, window binary").collect())
    if not found:
        return None
    x = np.frombuffer(b"".join(w for _, w in found), dtype=np.uint8).reshape(-1, WINDOW)
    y = np.array([languages.index(lang) for lang, _ in found])
    return ByteNetwork(languages, filters).fit(x, y)


def language_id(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    modulus: int = 4,
    held: int = 2,
    network: ByteNetwork | None = None,
) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Without a ``network`` one is trained on the rows that are not held out and whose language is
    known. A null text, and one without any letter, is ``und`` with score 0, and so is every
    text if nothing could be learned. Rows with a null id are held out. Ties go to the first
    language by name. An empty table gives an empty result; other columns are ignored.
    """
    rest = F.coalesce(remainder(quoted(id_col), modulus), F.lit(held))
    if network is None:
        network = train(docs.where(rest != held), text_col, lang_col)
    source = narrow(docs, id_col, text_col).withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), modulus), F.lit(held)) == held)
    model = docs.sparkSession.sparkContext.broadcast(network)  # a few kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in _slices(batch, "text"):
                texts = cut.column("text").to_pylist()
                named, scores = predict(model.value, texts) if model.value else (["und"] * len(texts), [0.0] * len(texts))
                arrays = [cut.column("doc_id"), cut.column("held_out"), pa.array(named, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score"])

    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))
