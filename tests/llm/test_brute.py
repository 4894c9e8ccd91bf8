"""Operators against brute force, exact round trips and held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollmark.llm import components, exact_dedup, language_id, near_dedup, packing, pieces, quality_classifier, quality_rules, registry, substring_dedup, toxicity

from .conftest import words

DATA = "/root/testdata/sf0.001"


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


# ---- pieces ----


@pytest.fixture(scope="module")
def coder():
    return pieces.coder("piece_bpe_32k.model")


def test_bpe_equals_the_library(coder):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(3)
    texts = ["", " ", "a  b", " " * 40 + "x", "ab\n\n c\t", "naïve 日本語 😀", "aaaaaaaaaaaaaaaaaaaa", "def f(x):\n    return 1.5e-3\n"]
    texts += ["".join(r.choice("abcdeilnorst  .,-#1é") for _ in range(r.randrange(200))) for _ in range(300)]
    for text in texts:
        assert coder.encode(text).tolist() == library.encode(text)
        assert coder.decode(coder.encode(text).tolist()) == text


def test_streaming_equals_whole(coder):
    text = "the quick brown fox " * 5 + "x" * 3000 + "日" * 50
    marked = pieces.MARK + text.replace(" ", pieces.MARK)
    runs = list(coder.stream(marked))
    assert [i for run in runs for i in run] == coder.encode(text).tolist()
    assert max(map(len, runs)) < 100 and len(runs) > 30


def test_real_documents_go_through_the_stream(monkeypatch):
    """What the cache holds was committed by the streaming pass, and it equals the library's ids."""
    import duckdb
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    tool, library = pieces.PieceCoder.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    stream, committed = pieces.PieceCoder.stream, {}

    def counted(self, text):
        runs = list(stream(self, text))
        committed[text] = [i for run in runs for i in run]
        return iter(runs)

    monkeypatch.setattr(pieces.PieceCoder, "stream", counted)
    texts = [t or "" for (t,) in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet'").fetchall()]
    for text in texts:
        ids = tool.encode(text).tolist()
        assert ids == library.encode(text) and tool.decode(ids) == text
    assert len(committed) > 10_000
    for span, ids in tool.cache.items():
        assert span in committed or len([k for k in range(1, len(span)) if span[k - 1 : k + 1] not in tool.pairs]) > 0
        if span in committed:
            assert np.frombuffer(ids, np.int32).tolist() == committed[span]


def test_forgetting_changes_no_ids(monkeypatch, coder):
    """What is remembered of neighbours and of steps is dropped in the middle of a text."""
    import public_tokenizers

    monkeypatch.setattr(pieces, "HELD", 7)
    tool = pieces.PieceCoder.load(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(4)
    for text in ["".join(r.choice("abcdeilnorst  .,-#1é日\x01😀▁") for _ in range(r.randrange(300))) for _ in range(100)]:
        assert tool.encode(text).tolist() == coder.encode(text).tolist()
        assert tool.decode(tool.encode(text)) == text


def unigram(pieces_, seed=0):
    r = random.Random(seed)
    return pieces.PieceCoder({p: (i, -r.randrange(1, 60) / 7) for i, p in enumerate(pieces_)}, list(range(1000, 1256)), "unigram")


def brute_score(coder, text):
    best = {0: 0.0}
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            s = coder.scores.get(text[i:j])
            if s is None and j == i + 1:
                s = coder.unknown
            if s is not None and best[i] + s > best.get(j, -math.inf):
                best[j] = best[i] + s
    return best[len(text)]


def test_unigram_is_the_best_path():
    coder = unigram(["a", "b", "ab", "ba", "aba", "bab", "abab", "▁", "▁a", "▁ab", "b▁"], 5)
    r = random.Random(8)
    for _ in range(200):
        text = "".join(r.choice("abc▁") for _ in range(r.randrange(1, 60)))
        ids = [i for run in coder.stream(text) for i in run]
        score = sum(coder.scores[p] for i in ids if i < 1000 for p in [next(k for k, v in coder.ids.items() if v == i)])
        score += coder.unknown * text.count("c")
        assert score == pytest.approx(brute_score(coder, text))


def test_decode_frame(spark):
    docs = docs_of(spark, ["a b", "", "▁x"])
    back = pieces.decode_pieces(pieces.encode_pieces(docs))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {0: "a b", 1: "", 2: "▁x"}


# ---- packing ----


def test_packing_cuts_whole_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join(words(n, n)) for n in (0, 1, 5, 3000, 7, 900)] + ["it's éa 12½ <|endoftext|>! İ ẞ", "q̃́ é"]
    rows = packing.pack_documents(docs_of(spark, texts), length=256, with_ids=True).collect()
    for i, text in enumerate(texts):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        ids = [x for r in own for x in r["ids"]]
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids + [1]
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["doc_tokens"] == len(ids)
    filled = Counter()
    for r in rows:
        filled[r["sequence_id"]] += r["length"]
    assert all(n == 256 for s, n in filled.items() if s != max(filled))


def test_ids_of_any_text_are_the_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    cache = packing.tokenizer_cache("word_bpe_49k.json")
    r = random.Random(11)
    odd = "İıẞßΣςσ½Ⅷ²ªµK\u212b\u0301\u0307\u0345\u1161\u11a8가ᄀ日😀'’-_.,!<|>\t\n\r\x0b\x1c\x85\xa0\u2028\u200d\ufeff\U000142eb\U000139b2\U00014923"
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "'s", "'LL", "'ſ", "the", "Straße", "a" * 30]
    anywhere = lambda: chr(r.choice([r.randrange(0x80), r.randrange(0x250), r.randrange(0xD800), r.randrange(0xE000, 0x30000), r.randrange(0x110000 - 0xE000) + 0xE000]))
    texts = ["İ!", "a <|endoftext|> b", "a<|endoftext|>b <|startoftext|>İ", "Ὀδυσσεύς ΟΔΥΣΣΕΎΣ"]
    for _ in range(20_000):
        parts = [r.choice([lambda: r.choice(odd), lambda: r.choice(marks), anywhere, lambda: r.choice("abcXYZ12 "), lambda: " "])() for _ in range(r.randrange(1, 14))]
        texts.append("".join(parts))
    got = packing.encode_texts(texts, cache)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, cache.kind).tolist() == plain.encode(text, add_special_tokens=False).ids, ascii(text)


# ---- rules ----


def test_binomial_tail(spark):
    rows = [(50, 0), (50, 3), (400, 1), (4000, 20), (3, 3)]
    frame = spark.createDataFrame(rows, "n long, k long")
    for r in frame.select("n", "k", quality_rules.log_binomial_tail(F.col("n"), F.col("k"), 0.01).alias("t")).collect():
        wanted = sum(math.comb(r["n"], j) * 0.01**j * 0.99 ** (r["n"] - j) for j in range(r["k"] + 1))
        assert math.exp(r["t"]) == pytest.approx(wanted, rel=1e-9)


def certified_by_hand(shares, risk, level):
    """The last step of the ladder before the first that fails; -1 if that is the first."""
    n, found = len(shares), -1
    for step in range(quality_rules.STEPS):
        k = sum(any(s[r] > quality_rules.LADDERS[r][step] for r in quality_rules.RULES) for s in shares)
        if sum(math.comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(k + 1)) > level:
            return found
        found = step
    return found


def test_steps_are_certified(spark):
    r = random.Random(6)
    rows = []
    for stratum, n, odd, share in (("a", 2000, 2, 0.9), ("b", 500, 0, 0.0), ("c", 430, 0, 0.0), ("d", 3000, 200, 0.5), ("e", 5, 0, 0.0), ("f", 1500, 9, 0.31)):
        rows += [(stratum, *(share if i < odd and k == i % 5 else r.random() * 0.01 for k in range(5))) for i in range(n)]
    held = spark.createDataFrame(rows, "stratum string, " + ", ".join(f"{x} double" for x in quality_rules.RULES))
    found = {x["stratum"]: x["step"] for x in quality_rules.certified_steps(held, 0.01, 0.05).collect()}
    wanted = {s: certified_by_hand([dict(zip(quality_rules.RULES, x[1:], strict=True)) for x in rows if x[0] == s], 0.01, 0.05 / 6) for s in "abcdef"}
    assert found == {s: step for s, step in wanted.items() if step >= 0}
    assert found["a"] == quality_rules.STEPS - 1 and found["b"] == quality_rules.STEPS - 1 and 0 < found["d"] < quality_rules.STEPS - 1 and "c" not in found and "e" not in found


def test_certified_rules_reject(spark):
    """Two strata with certified cutoffs and one without, against the SQL."""
    import duckdb

    r, docs, labels = random.Random(3), [], []
    for lang, n in (("en", 700), ("de", 600), ("fr", 300)):
        for i in range(n):
            parts = words(60, (lang, i).__repr__(), 5000)
            if i % 10 == 0:
                parts = [w + r.choice(["###", "||||", "$$"]) for w in parts]
            docs.append((len(docs), "\n".join(" ".join(parts[k : k + 6]) for k in range(0, 60, 6)), lang))
            labels.append((docs[-1][0], int(i % 10 != 0), 0))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    frame = quality_rules.quality_rules(docs, labels)
    rows = frame.collect()
    gone = {x["doc_id"] for x in rows if x["failed_rules"]}
    assert gone == {i for i in range(1300) if (i if i < 700 else i - 700) % 10 == 0} and all("symbol_share" in x["failed_rules"] and not x["kept"] for x in rows if x["doc_id"] in gone)
    connection = duckdb.connect()
    connection.register("documents", docs.toPandas())
    connection.register("labels", labels.toPandas())
    columns = sorted(frame.columns)
    wanted = connection.sql(quality_rules.ORACLE).select(*columns).fetchall()
    assert sorted(tuple(str(x[c]) for c in columns) for x in rows) == sorted(tuple(map(str, x)) for x in wanted)


def test_repeated_windows(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice("ab") for _ in range(n)) for n in (0, 2, 3, 4, 9, 40)] + [" ".join(words(300, 1, 12)), " ".join(words(300, 1, 5000))]
    frame = docs_of(spark, texts).select("doc_id", F.split("text", " ").alias("w")).withColumn("w", F.filter("w", lambda x: x != ""))
    got = {x["doc_id"]: x["n"] for x in frame.select("doc_id", quality_rules.repeat_words(F.col("w")).alias("n")).collect()}
    for i, text in enumerate(texts):
        w = text.split()
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        assert got[i] == len(hit)


# ---- near duplicates ----


def test_signatures_are_unbiased():
    r = np.random.default_rng(1)
    universe = r.integers(0, 2**63, 300).astype(np.uint64)
    a, b = r.integers(0, 9, 300), r.integers(0, 9, 300)
    b[:200] = a[:200]
    wanted = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    h = np.concatenate([universe[a > 0], universe[b > 0]])
    d = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
    w = np.concatenate([a[a > 0], b[b > 0]])
    s = near_dedup.signatures(h, d, w, 3, 4096)
    assert abs((s[0] == s[1]).mean() - wanted) < 0.03
    assert np.isinf(s[2]).all()
    alone = near_dedup.signatures(h[d == 1], d[d == 1] - 1, w[d == 1], 1, 4096)
    assert (alone[0] == s[1]).all()  # whatever else is in the batch


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(f"e{r.randrange(10**6)}" if r.random() < share else w for w in text.split())


def test_classes_equal_brute_force(spark):
    texts = []
    for g in range(6):
        base = " ".join(words(150, 100 + g, 3000))
        texts += [base, base, *[edited(base, s, g * 31 + k) for k, s in enumerate((0.005, 0.01, 0.02, 0.03, 0.05, 0.1) * 3)]]
    passage = " ".join(words(60, 7, 3000))
    texts += [passage + " " + " ".join(words(40, 900 + k, 3000)) for k in range(25)]
    texts += ["same few words", "same few words", "other few words", "a a a a a a a a", "a a a a a a a"]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(docs_of(spark, texts)).collect()}
    assert got == classes_by_hand(texts)


def classes_by_hand(texts):
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if near_dedup.similarity(texts[i], texts[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


@pytest.mark.parametrize(("hot_pairs", "late_tokens"), [(40, near_dedup.LATE_TOKENS), (40, 3)])
def test_texts_that_meet_in_one_shingle(spark, hot_pairs, late_tokens):
    """Many texts with one shingle, many with most of a text in common, and near copies among both."""
    rare, frame = " ".join(words(5, 1, 10**6)), words(150, 2, 10**6)
    texts = [f"{' '.join(words(60, 300 + i, 10**6))} {rare}" for i in range(60)]
    texts += [edited(t, 0.01, i) for i, t in enumerate(texts[:20])]
    texts += [" ".join(frame[:120] + words(24, 500 + i, 10**6)) for i in range(40)]  # just under 0.8 alike
    texts += [edited(t, 0.01, 70 + i) for i, t in enumerate(texts[80:100])]
    texts += [edited(" ".join(frame), 0.02, 900 + i) for i in range(30)]
    nodes = spark.createDataFrame([(i, i) for i in range(len(texts))], "node long, label long")
    stored = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    none = spark.createDataFrame([], "a long, b long")
    links = near_dedup.compare(nodes, stored, none, none, 5, 0.8, hot_pairs, late_tokens)
    found = {r["node"]: r["label"] for r in components.connected_components(links).collect()}
    assert {i: found.get(i, i) for i in range(len(texts))} == classes_by_hand(texts)
    if late_tokens > 3:
        got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(docs_of(spark, texts), hot_pairs=hot_pairs).collect()}
        assert got == classes_by_hand(texts)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 5), (200, 201), (201, 200), (300, 300)]
    found = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in [*range(41), 100]) and found[200] == found[201] == 200


# ---- exact copies and passages ----


def test_colliding_digests_are_told_apart(spark):
    texts = [f"t{i % 7} {' ' * (i % 3)}x" for i in range(60)]
    rows = exact_dedup.exact_dedup(docs_of(spark, texts), digest_chars=1).collect()
    for r in rows:
        same = [i for i, t in enumerate(texts) if t.replace(" ", "") == texts[r["doc_id"]].replace(" ", "")]
        assert r["group_size"] == len(same)
        assert r["keep_id"] == min(same, key=lambda i: (-len(texts[i]), i)) and r["kept"] == (r["doc_id"] == r["keep_id"])


@pytest.mark.parametrize("hot_share", [1, 1000])
def test_hot_groups(spark, hot_share):
    texts = ["hot"] * 300 + [f"cold {i}" for i in range(50)]
    rows = exact_dedup.exact_dedup(docs_of(spark, texts), hot_share=hot_share).collect()
    assert sum(r["kept"] for r in rows) == 51 and {r["group_size"] for r in rows} == {300, 1}


@pytest.mark.parametrize("window", [4, 10, 50])
def test_passages_equal_brute_force(spark, window):
    r = random.Random(window)
    shared = [words(120, 50 + k, 30) for k in range(4)]
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(r.randrange(0, 4)):
            parts += words(r.randrange(0, 60), r.random(), 30)
            s = r.choice(shared)
            a = r.randrange(0, 60)
            parts += s[a : a + r.randrange(10, 120)]
        texts.append(" ".join(parts))
    first = {}
    split = [t.split() for t in texts]
    for i, w in enumerate(split):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    rows = substring_dedup.substring_dedup(docs_of(spark, texts), window=window, with_text=True).collect()
    for row in rows:
        w = split[row["doc_id"]]
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < row["doc_id"] for j in range(k, k + window)}
        assert row["n_removed"] == len(gone) and row["n_words"] == len(w)
        assert row["kept_text"] == " ".join(x for j, x in enumerate(w) if j not in gone)


# ---- classifiers ----


def tables(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def test_language_held_out(spark):
    rows = language_id.language_id(tables(spark, "documents")).join(tables(spark, "documents").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.9


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 40 and np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.9


def group_rows(r, named):
    """Toxic documents that name one group more often than another, and neutral mentions of both."""
    filler = lambda: " ".join(r.choice(["tree", "house", "river", "walks", "sees", "near"]) for _ in range(8))
    first, second = named
    texts = [(f"{filler()} vile {filler()} {first}", 1) for _ in range(60)] + [(f"{filler()} vile {filler()} {second}", 1) for _ in range(6)]
    texts += [(f"{filler()} {filler()} {second}", 0) for _ in range(60)] + [(f"{filler()} {first} {filler()}", 0) for _ in range(6)]
    texts += [(f"{filler()}. {filler()}", 0) for _ in range(60)]
    return texts


def test_counterfactual_penalty_narrows_the_gap(spark):
    rows = group_rows(random.Random(5), ("muslims", "christians"))
    probes = ["the muslims walk near the river", "the christians walk near the river", "the vile river", "the river"]
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5][: len(rows)]
    docs = spark.createDataFrame([*zip(ids, [t for t, _ in rows], strict=True), *((5000 + k, t) for k, t in enumerate(probes))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in zip(ids, rows, strict=True)], "doc_id long, toxic int")
    logit = lambda p: math.log(p / (1 - p))
    gap = {}
    for penalty in (0.0, 10.0):
        scores = [r["score"] for r in sorted(toxicity.toxicity(docs, labels, penalty=penalty).where("doc_id >= 5000").collect())]
        gap[penalty] = abs(logit(scores[0]) - logit(scores[1]))
        assert scores[2] > scores[3]
    assert gap[10.0] < 0.3 * gap[0.0] and scores[0] < 0.5 and scores[1] < 0.5


def test_names_that_no_document_has(spark):
    """The names share their first letters with toxic words, and are in no labelled document."""
    rows = [(t.replace("vile", f"muslim{'xyz'[i % 3]}oid"), y) for i, (t, y) in enumerate(group_rows(random.Random(6), ("these", "those")))]
    sample = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, label int")
    sets = (("muslims", "christians"), ("women", "men"))
    loose, held = (toxicity.fit_toxicity(sample, penalty, sets) for penalty in (0.0, 10.0))
    assert held.report["swapped"] == 0 and held.report["made"] == 2 * 2 * 2 * toxicity.MADE
    gap = lambda m: abs(m.logit(["muslims", "walk"]) - m.logit(["christians", "walk"]))
    assert gap(held) < 0.3 * gap(loose) and held.report["gap"] < loose.report["gap"]
    assert held.score("muslimxoid river") > 0.5 > held.score("the muslims walk")


def test_em_finds_the_good_labellers():
    r = np.random.default_rng(2)
    truth = r.random(20_000) < 0.8
    accuracy = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.6, 0.55])
    votes = np.where(r.random((20_000, 8)) < accuracy, truth[:, None], ~truth[:, None]) * 2
    votes[r.random((20_000, 8)) < 0.2] = 1
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, rates = quality_classifier.expectation_maximisation(patterns, counts.astype(float), share=0.0)
    assert np.mean((post[inverse.reshape(-1)] > 0.5) == truth) > 0.95
    good = rates[1][:, 2] / (rates[1][:, 2] + rates[1][:, 0])
    assert np.abs(good - accuracy).max() < 0.05


def test_quality_agrees_with_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_classifier.quality_classifier(docs).join(labels, "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.3


# ---- queries with SQL ----


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    for table in ("documents", "labels"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    frame = registry.QUERIES[name](spark, DATA)
    wanted = connection.sql(registry.ORACLES[name])
    columns = sorted(frame.columns)
    assert columns == sorted(wanted.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in frame.collect())
    assert got == sorted(tuple(map(str, r)) for r in wanted.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("window", [4, 6, 10, 50, 100])
def test_runs_hold_every_window_and_equal_windows_have_equal_stretches(window):
    r = random.Random(window)
    texts = [" ".join(r.choice("abc") for _ in range(r.randrange(0, 3 * window))) for _ in range(60)] + ["", "a", " ".join("a" * 5 * window)]
    levels = substring_dedup.lengths(window)
    assert levels[-1] == window and all(short < long <= 2 * short for short, long in zip(levels, levels[1:], strict=False))
    found = substring_dedup.runs_of_windows(texts, window)
    seen, places = {}, []
    for k in range(len(found["row"])):
        words_of = texts[found["row"][k]].split()
        for first in range(found["first"][k], found["first"][k] + found["runs"][k]):
            stretches = tuple(int(level[k]) for level in found["stretches"])
            assert len(stretches) == len(levels) - 1
            assert seen.setdefault(tuple(words_of[first : first + window]), stretches) == stretches
            places.append((found["row"][k], first))
    assert sorted(places) == [(i, s) for i, t in enumerate(texts) for s in range(len(t.split()) - window + 1)]
