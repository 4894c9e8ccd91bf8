"""Near-duplicate classes by BagMinHash signatures, bands and exact verification.

A document is the multiset of its shingles of five words. BagMinHash draws, for every
shingle, the points of a Poisson process over (time, weight): the unit weight intervals
1, 2, 3-4, 5-8, ... form a hierarchy, an interval of width ``w`` has a process of rate ``w``
seeded by (shingle, interval), and a point counts if its weight level does not exceed the
shingle's multiplicity. A point falls on one component of the signature, and a component
keeps its earliest point. Two documents agree in a component with probability
``sum(min) / sum(max)``, their weighted Jaccard similarity. Only points before a time bound
that fills all components are drawn, so the work hardly depends on the document's length.

Components are cut into bands; documents that agree in a whole band share a bucket and are
candidates. Documents with equal multisets are one representative. Buckets are not paired off:

1. Every member is verified against one hub, a bucket's most central member (the one with most
   company in all its buckets; in a group of copies that is the original). Links are joined
   to components, and a bucket within one component is done.
2. Members of buckets that still hold several components are compared by a prefix filter: two
   texts of similarity t share one of the rarest ``1 - t`` of their shingles, in any fixed
   order of shingles, and in the smaller text it is among the rarest ``(1 - t) / (1 + t)``. Passages
   that many documents share come last in the order, so they bring no pairs about. Pairs across
   components that share such a shingle are verified.
3. The order of step 2 comes from counters of fixed number. Where it still lets many texts meet in one
   shingle, the texts that met there are ordered anew, with all such shingles last, as long as that halves the pairs.
   If these are too many to send around, exact counts of all shingles give the order. What meets in many then
   are texts made of common shingles nearly throughout. These are verified
   against one hub for each such shingle, round by round, and joined. What remains in different components
   when a round joins less than a tenth of the texts it asked is compared by the filter of step 2.

Verification compares the whole multisets.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import HOT_SHARE, documents, narrow, parts, saved, skew_join, stored
from .components import connected_components
from .substring_dedup import Rolling, _signed, _slices, mix, word_hashes

SHINGLE = 5
BANDS, ROWS = 32, 6
#: Counters that order shingles by frequency; the table of counts is broadcast, its size is fixed.
COUNTERS = 1 << 16
#: So many pairs may meet in one shingle before its texts are ordered anew.
HOT_PAIRS = 1 << 14
#: So many shingles may be sent to every worker as those that come last (8 bytes each).
LATE_TOKENS = 1 << 20


def shingle_hashes(texts: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, and the text of each. A text of fewer than k words
    has one shingle, all its words; one without words has none."""
    flat, counts = word_hashes(texts)
    rolling = Rolling(flat)
    ends = np.cumsum(counts)
    starts = np.arange(len(flat))
    doc = np.searchsorted(ends, starts, side="right")
    begin = (ends - counts)[doc]
    size = np.minimum(k, counts[doc])
    inside = (starts + size <= ends[doc]) & ((counts[doc] >= k) | (starts == begin))
    starts, doc, size = starts[inside], doc[inside], size[inside]
    return rolling.at(starts, size) + size.astype(np.uint64), doc


def multisets(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) and multiplicity, ordered by document."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return h[at], d[at], np.diff(np.append(at, len(h)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(hashes: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """BagMinHash signatures (n_docs x size) of multisets; infinite for empty ones."""
    out = np.full(n_docs * size, np.inf)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    # the hierarchy: one row for each interval (low, high] of weights that the shingle reaches
    level = np.zeros(len(weight), dtype=np.int64)
    parts = [(np.arange(len(weight)), level)]
    k, reach = 1, np.flatnonzero(weight > 1)
    while len(reach):
        parts.append((reach, np.full(len(reach), k)))
        reach, k = reach[weight[reach] > 2**k], k + 1
    item = np.concatenate([p[0] for p in parts])
    level = np.concatenate([p[1] for p in parts])
    low = np.where(level == 0, 0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, low)
    seed = mix(hashes[item] ^ (level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    owner, upto = doc[item], weight[item]
    time = np.zeros(len(item))
    bound = np.where(total > 0, (np.log(size) + 3.0) * size / np.maximum(total, 1), 0.0)
    step = np.zeros(len(item), dtype=np.uint64)
    pending = np.arange(len(item))
    while len(pending):
        living, block = pending, 1
        while len(living):
            # the next ``block`` points of each process; sums run from left to right, so a point
            # has the same time in every document, whatever the blocks
            nth = step[living][:, None] + np.arange(block, dtype=np.uint64)
            fresh = mix(seed[living][:, None] + nth * np.uint64(0x9E3779B97F4A7C15))
            wait = -np.log(_uniform(fresh)) / width[living][:, None]
            arrival = np.cumsum(np.concatenate([time[living][:, None], wait], axis=1), axis=1)[:, 1:]
            step[living] += np.uint64(block)
            time[living] = arrival[:, -1]
            second = mix(fresh + np.uint64(0xA0761D6478BD642F))
            height = low[living][:, None] + np.ceil(_uniform(second) * width[living][:, None])
            component = (mix(second + np.uint64(0xE7037ED1A0B428DB)) % np.uint64(size)).astype(np.int64)
            counts = height <= upto[living][:, None]
            np.minimum.at(out, (owner[living][:, None] * size + component)[counts], arrival[counts])
            living = living[time[living] <= bound[owner[living]]]
            block = max(1, min(2 * block, 1024, 500_000 // max(1, len(living))))
        # a document with an empty component, or one later than its bound, needs a later bound
        late = (out.reshape(n_docs, size).max(axis=1) > bound) & (total > 0)
        bound[late] *= 2
        pending = np.flatnonzero(late[owner] & (time <= bound[owner]))
        if not len(pending) and late.any():
            continue_docs = np.flatnonzero(late)
            while not len(pending):
                bound[continue_docs] *= 2
                pending = np.flatnonzero(late[owner] & (time <= bound[owner]))
    return out.reshape(n_docs, size)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), bits.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, r])
    return key


def similarity(a: str, b: str, k: int = SHINGLE) -> float:
    """Weighted Jaccard similarity of two texts; 1 for two texts without words."""
    hashes, doc = shingle_hashes([a, b], k)
    x, y = Counter(hashes[doc == 0].tolist()), Counter(hashes[doc == 1].tolist())
    union = (x | y).total()
    return (x & y).total() / union if union else 1.0


def sketch(source: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, the multiset's fingerprint and size, and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in _slices(batch, "text", 1_000_000):
                n = cut.num_rows
                h, d, w = multisets(*shingle_hashes(cut.column("text").to_pylist(), k))
                total = np.bincount(d, weights=w, minlength=n).astype(np.int64)
                prints = []
                for salt in (0x1234567, 0xABCDEF1):
                    x = mix(mix(h + np.uint64(salt)) * (w.astype(np.uint64) * np.uint64(2) + np.uint64(1)) + w.astype(np.uint64))
                    sums = np.zeros(n, dtype=np.uint64)
                    np.add.at(sums, d, x)
                    prints.append(sums)
                keys = band_keys(signatures(h, d, w, n, bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), _signed(keys.reshape(-1)))
                arrays = [cut.column("doc_id"), cut.column("text_hash"), _signed(prints[0]), _signed(prints[1]), pa.array(total), lists]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "print1", "print2", "total", "keys"])

    return source.mapInArrow(run, "doc_id long, text_hash long, print1 long, print2 long, total long, keys array<long>")


def verify(pairs: DataFrame, texts: DataFrame, k: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Counter] = {}
        for batch in batches:
            for cut in parts(batch, 64):
                keep = []
                for a, ta, tb in zip(*(cut.column(c).to_pylist() for c in ("a", "ta", "tb")), strict=True):
                    if a not in known:
                        if len(known) > 16:
                            known.clear()
                        known[a] = Counter(shingle_hashes([ta], k)[0].tolist())
                    x, y = known[a], Counter(shingle_hashes([tb], k)[0].tolist())
                    both = (x & y).total()
                    union = x.total() + y.total() - both
                    keep.append(union == 0 or both >= least * union - 1e-9)
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([cut.column("a").filter(mask), cut.column("b").filter(mask)], ["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _tokens(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all texts, and the text of each; a repeated shingle is a new token each time."""
    h, d, w = multisets(*shingle_hashes(texts, k))
    nth = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
    return mix(np.repeat(h, w) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.repeat(d, w)


def rarity(texts: DataFrame, k: int) -> np.ndarray:
    """How often the shingles of each counter occur in all texts; a fixed number of counters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for cut in _slices(batch, "text", 1_000_000):
                h, _ = _tokens(cut.column("text").to_pylist(), k)
                total += np.bincount((h % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["counter", "n"])

    counts = np.zeros(COUNTERS, dtype=np.int64)
    for row in texts.select("text").mapInArrow(count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).collect():
        counts[row["counter"]] = row["n"]
    return counts


def rare_shingles(texts: DataFrame, k: int, least: float, counts: np.ndarray, last: np.ndarray) -> DataFrame:
    """token, before, place, node, label, total: of each text (node, label, text) the rarest shingles, as many as
    one of them must be in any text of similarity ``least``. Rarity is read off ``counts``: a counter shared
    by rare shingles changes the order, not the result. The tokens in ``last`` (sorted) come after all others."""
    shared = texts.sparkSession.sparkContext.broadcast((counts, last))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, last = shared.value
        for batch in batches:
            for cut in _slices(batch, "text", 1_000_000):
                h, d = _tokens(cut.column("text").to_pylist(), k)
                frequent = counts[(h % np.uint64(COUNTERS)).astype(np.int64)]
                late = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h if len(last) else np.zeros(len(h), dtype=bool)
                order = np.lexsort((h, frequent, late, d))
                h, d = h[order], d[order]
                sizes = np.bincount(d, minlength=cut.num_rows)
                place = np.arange(len(d)) - (np.cumsum(sizes) - sizes)[d]
                keep = place <= sizes[d] - np.ceil(least * sizes[d] - 1e-9)
                rows = pa.array(d[keep])
                before = np.roll(h, 1)
                arrays = [_signed(h[keep]), _signed(before[keep]), pa.array(place[keep]), cut.column("node").take(rows), cut.column("label").take(rows), pa.array(sizes[d[keep]])]
                yield pa.RecordBatch.from_arrays(arrays, ["token", "before", "place", "node", "label", "total"])

    return texts.select("node", "label", "text").mapInArrow(rare, "token long, before long, place long, node long, label long, total long")


def ordered_shingles(texts: DataFrame, k: int, least: float) -> DataFrame:
    """The columns of ``rare_shingles``, in the order of exact counts: shingles that texts of one label alone
    have, then those of fewest texts. The former bring no pairs about and are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in _slices(batch, "text", 1_000_000):
                h, d = _tokens(cut.column("text").to_pylist(), k)
                rows = pa.array(d)
                sizes = np.bincount(d, minlength=cut.num_rows)
                arrays = [_signed(h), cut.column("node").take(rows), cut.column("label").take(rows), pa.array(sizes[d])]
                yield pa.RecordBatch.from_arrays(arrays, ["token", "node", "label", "total"])

    tokens = saved(texts.select("node", "label", "text").mapInArrow(run, "token long, node long, label long, total long"))
    total = tokens.count()
    counts = tokens.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("meets", F.col("lo") < F.col("hi")).where(F.col("meets") | (F.col("n") * HOT_SHARE >= total))
    met = skew_join(tokens, saved(counts.select("token", "n", "meets")), ["token"], total).where("meets")
    own = Window.partitionBy("node").orderBy("n", "token")
    alone = F.col("total") - F.count(F.lit(1)).over(Window.partitionBy("node"))
    placed = met.select(
        "token",
        F.coalesce(F.lag("token").over(own), F.col("node")).alias("before"),
        (alone + F.row_number().over(own) - 1).alias("place"),
        "node",
        "label",
        "total",
    )
    return placed.where(F.col("place") <= F.col("total") - F.ceil(F.col("total") * F.lit(least) - 1e-9))


def _leads(least: float) -> Column:
    """Whether a text's shingle can be the first that it shares with a text of its size or more."""
    return F.col("place") <= F.col("total") * F.lit((1 - least) / (1 + least)) + 1e-6


def meeting_places(prefixes: DataFrame, least: float, total: int) -> DataFrame:
    """token, n (texts), pairs: shingles in which texts of several labels meet, and how many pairs at most. Shingles
    that a large share of all rows has are there too, with pairs = 0 if nothing meets in them."""
    found = prefixes.groupBy("token").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum(_leads(least).cast("long")).alias("m")
    )
    found = found.select("token", "n", F.when(F.col("lo") < F.col("hi"), F.col("n") * F.col("m")).otherwise(0).alias("pairs"))
    return found.where((F.col("pairs") > 0) | (F.col("n") * HOT_SHARE >= total))


def meeting_pairs(prefixes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of different labels that meet in a shingle and may be similar enough."""
    smaller = prefixes.where(_leads(least)).select(
        "token", F.col("before").alias("ta"), F.col("place").alias("pa"), F.col("node").alias("a"), F.col("label").alias("la"), F.col("total").alias("wa")
    )
    other = prefixes.select("token", F.col("before").alias("tb"), F.col("place").alias("pb"), F.col("node").alias("b"), F.col("label").alias("lb"), F.col("total").alias("wb"))
    return (
        smaller.join(other, "token")
        .where((F.col("wa") < F.col("wb")) | ((F.col("wa") == F.col("wb")) & (F.col("a") < F.col("b"))))
        .where((F.col("la") != F.col("lb")) & (F.col("wa") >= F.col("wb") * F.lit(least) - 1e-6))
        # if this is the first shingle that the two share, no more than what follows it can be shared
        .where(F.least(F.col("wa") - F.col("pa"), F.col("wb") - F.col("pb")) >= (F.col("wa") + F.col("wb")) * F.lit(least / (1 + least)) - 1e-6)
        # a pair that shares the shingle before this one as well has been found by that
        .where((F.col("pa") == 0) | (F.col("pb") == 0) | (F.col("ta") != F.col("tb")))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def compare(nodes: DataFrame, texts: DataFrame, links: DataFrame, tried: DataFrame, k: int, least: float, hot_pairs: int, late_tokens: int = LATE_TOKENS) -> DataFrame:
    """Links (a, b) between texts of ``nodes`` (node, label) with different labels, steps 2 and 3 above.

    ``links`` are those that made the labels, ``tried`` the pairs (a, b; both ways) verified before."""

    def met(prefixes: DataFrame, total: int) -> DataFrame:
        cells = stored(meeting_places(prefixes, least, total))
        return stored(skew_join(prefixes, cells, ["token"], total).where("pairs > 0"))

    none = np.zeros(0, dtype=np.uint64)
    wanted = texts.join(nodes, "node").select("node", "label", "text")
    prefixes = stored(rare_shingles(wanted, k, least, rarity(wanted, k), none))
    rows = met(prefixes, prefixes.count())
    pairs = meeting_pairs(rows.where(F.col("pairs") <= hot_pairs), least)
    more = links.limit(0)
    crowd = rows.where(F.col("pairs") > hot_pairs).select("node", "label").distinct()
    if crowd.limit(1).count():
        wanted = stored(texts.join(stored(crowd), "node").select("node", "label", "text"))
        counts, last, before = rarity(wanted, k), none, float("inf")
        while True:
            # the shingles that too many texts meet in come last; their place is taken by others
            hot = rows.where(F.col("pairs") > hot_pairs).select("token").distinct()
            load = rows.where(F.col("pairs") > hot_pairs).agg(F.sum(F.col("pairs") / F.col("n")).alias("load")).first()["load"] or 0.0
            if load * 2 > before:  # the order has done what it can
                break
            before = load
            fresh = np.array([r["token"] for r in hot.limit(late_tokens + 1).collect()], dtype=np.int64).view(np.uint64)
            fresh = np.setdiff1d(fresh, last)
            if not len(fresh):
                break
            last = np.union1d(last, fresh)
            if len(last) > late_tokens:  # too many to send to every worker: exact counts say which
                prefixes = stored(ordered_shingles(wanted, k, least))
                rows = met(prefixes, prefixes.count())
                break
            prefixes = stored(rare_shingles(wanted, k, least, counts, last))
            rows = met(prefixes, prefixes.count())
        total, turn = prefixes.count(), 0
        while True:
            hot = rows.where(F.col("pairs") > hot_pairs).select("token", "n", "node", "label")
            if not hot.limit(1).count():
                break
            hubs = hot.groupBy("token").agg(F.min_by(F.struct("node", "label"), F.xxhash64("node", "token", F.lit(turn))).alias("hub"), F.count(F.lit(1)).alias("n"))
            asked = skew_join(hot.drop("n"), stored(hubs), ["token"]).where("label <> hub.label")
            ballot = asked.groupBy("node").agg(F.max_by("hub.node", F.struct("n", F.xxhash64("hub.node", "node"))).alias("hub"))
            fresh = ballot.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
            fresh = stored(fresh.join(tried, ["a", "b"], "left_anti"))
            found = stored(verify(fresh, texts, k, least))
            tried = stored(tried.unionByName(fresh).unionByName(fresh.select(F.col("b").alias("a"), F.col("a").alias("b"))))
            more, turn = stored(more.unionByName(found)), turn + 1
            # go on while a tenth of the texts asked find company
            if found.count() * 10 <= fresh.count():
                break
            labels = connected_components(links.unionByName(more))
            prefixes = stored(prefixes.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
            rows = met(prefixes, total)
        pairs = pairs.unionByName(meeting_pairs(rows, least)).distinct()
    pairs = stored(pairs.join(tried, ["a", "b"], "left_anti"))
    return stored(more.unionByName(verify(pairs, texts, k, least)))


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = 0.8,
    k: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
    hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """One row per input row: doc_id, class_id (smallest id of its class), class_size, kept.

    A class is a connected component of texts whose multisets of word shingles have a weighted
    Jaccard similarity of at least ``least``. A pair of exactly 0.8 agrees in no band with a
    probability of 6 in 100,000; more similar pairs are missed less often. All that agree in
    one are either joined or compared. ``hot_pairs`` says when step 3 begins; it changes the work, not
    the result.

    Words are compared unchanged. Texts without words (null and empty ones) are alike. A text of
    fewer than ``k`` words is one shingle. Rows with a null id form no classes: each is returned
    with class_id null, class_size 1 and kept. Rows repeated with one id are one document; all of
    them carry its class, which joins the classes of all its texts, and they count once. Ties are broken by the smallest id. An empty
    table gives an empty result; other columns are ignored.
    """
    source = narrow(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    known = source.where("doc_id IS NOT NULL")
    sketches = saved(sketch(known, k, bands, rows))
    # a node is a multiset, whichever ids have it; its representative is the text of the smallest of these
    sketches = sketches.withColumn("node", F.xxhash64("print1", "print2", "total"))
    members = sketches.select("doc_id", "text_hash", "node")
    reps = saved(members.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("at")).select("node", "at.doc_id", "at.text_hash"))
    own = sketches.join(reps, ["node", "doc_id", "text_hash"]).dropDuplicates(["node", "doc_id", "text_hash"])
    entries = own.select("node", "total", F.explode("keys").alias("key"))
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = saved(entries.join(buckets, "key").select("key", "node", "total", "n"))
    central = saved(shared.groupBy("node").agg(F.sum("n").alias("company"), F.min("total").alias("total")))
    wanted = reps.join(central.select("node"), "node")
    texts = known.join(wanted, ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash").agg(F.min("text").alias("text"), F.min("node").alias("node"))
    texts = saved(texts.select("node", "text"))

    # round 1: each document with the hub of its fullest bucket
    ranked = shared.select("key", "node", "n").join(central.select("node", "company"), "node")
    hubs = ranked.groupBy("key").agg(F.max_by("node", F.struct(F.col("company"), -F.col("node"))).alias("hub"))
    votes = ranked.join(hubs, "key").where("node <> hub")
    first = votes.groupBy("node").agg(F.max_by("hub", F.struct(F.col("n"), -F.col("hub"))).alias("hub"))
    tried = saved(first.select(F.col("hub").alias("a"), F.col("node").alias("b")))
    links = saved(verify(tried, texts, k, least))
    labels = connected_components(links)

    # round 2: members of buckets that hold several components
    placed = shared.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    opened = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    open_nodes = saved(placed.join(opened, "key").select("node", "label").distinct())
    both_ways = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = compare(open_nodes, texts, links, both_ways, k, least, hot_pairs)
    # the texts of an id are one document
    several = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").select("doc_id", "a")
    same = members.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    labels = connected_components(links.unionByName(more).unionByName(same))

    classed = members.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("label"))
    one = saved(classed.groupBy("doc_id").agg(F.min("label").alias("label")))
    sizes = saved(one.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")).where("class_size > 1"))
    out = source.select("doc_id").join(one, "doc_id", "left").join(sizes, "label", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    return out.select(
        "doc_id",
        "class_id",
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("class_id"))).alias("kept"),
    )


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))
