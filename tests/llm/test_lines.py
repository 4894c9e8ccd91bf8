"""Which lines belong to a template."""

import random

import pytest

from rollmark.llm import line_templates


def kept(spark, texts, **options):
    rows = line_templates.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **options).collect()
    return {r["doc_id"]: r["kept_text"] for r in rows}


def test_leading_tokens_make_no_member(spark):
    texts = [f"Was erlytion that. {a}" for a in ("Are for.", "Upon us.", "Then some.", "Not here.", "All gone.", "One left.")]
    assert kept(spark, texts) == dict(enumerate(texts))


def test_template_with_a_free_word_goes(spark):
    texts = [f"Was erlytion that. {a}" for a in ("Are for.", "Upon us.")] + [f"Share this page with {w} now" for w in ("ann", "bob", "cem", "dee", "eve")]
    assert kept(spark, texts) == {0: texts[0], 1: texts[1]} | dict.fromkeys(range(2, 7), "")


@pytest.mark.parametrize("sizes", [(60, 40), (40, 40), (30, 30, 30, 8), (200, 6)])
def test_every_template_of_a_leaf_goes(spark, sizes):
    ends = ["share this page by mail or {} today", "sign up here and get {} free each", "more news about the town of {} below", "all old posts with a tag {} above"]
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    texts = [f"Click to read, {ends[k].format(word(100 * k + i))}" for k, n in enumerate(sizes) for i in range(n)]
    alone = ["Click to read, " + " ".join(f"{a}{word(i)}" for i in range(7)) for a in "xyz"]
    assert list(kept(spark, texts + alone).values()).count("") == len(texts)


def test_lines_that_share_only_the_token_of_their_part_stay(spark):
    texts = [f"Was erlytion that. {a} {word}" for a in ("Of", "And", "The") for word in (f"{a}{c}{c}" for c in "abcdef")]
    assert kept(spark, texts) == dict(enumerate(texts))


def letters(i):
    return "".join(chr(97 + int(c)) for c in str(i))


@pytest.mark.parametrize("seed", [1, 2])
def test_a_leaf_gives_the_same_in_one_worker_and_in_all(spark, seed):
    r = random.Random(seed)
    starts = ["Click to read", "All rights reserved", "Was erlytion that"]
    frames = [[r.choice(["a", "b", "c", "<free>", "<free>"]) + str(p).translate({48 + i: 97 + i for i in range(10)}) for p in range(6)] for _ in range(6)]
    fill = lambda frame: " ".join(letters(r.randrange(40)) if w.startswith("<free>") else w for w in frame)
    texts = ["\n".join(f"{r.choice(starts)} {fill(r.choice(frames))}" for _ in range(r.randrange(1, 4))) for _ in range(120)]
    texts += [texts[0] + "\nonly three tokens\nonly three tokens\nonly three else", "only three that"]
    one = kept(spark, texts)
    assert kept(spark, texts, leaf_tokens=0) == one
    assert 0 < sum(t != one[i] for i, t in enumerate(texts))


def test_a_driver_holds_no_more_for_more_levels(spark, monkeypatch):
    """Each level cuts one token's few lines off; estimates that multiply from level to level fill the driver's memory."""
    frames = []
    for name in ("saved", "stored"):
        save = getattr(line_templates, name, None)
        if save:
            monkeypatch.setattr(line_templates, name, lambda frame, save=save: frames.append(save(frame)) or frames[-1])
    places, texts = 7, []
    for i in range(6 * places):
        tokens = [f"x{letters(i)}{letters(p)}" for p in range(places)]
        tokens[i % places] = f"shared{letters(i % places)}"
        texts.append("Click to read " + " ".join(tokens))
    options = {"leaf_tokens": 0} if hasattr(line_templates, "LEAF_TOKENS") else {}
    digits = []
    monkeypatch.setattr(line_templates, "discard", lambda table: None, raising=False)
    assert kept(spark, texts, **options) == dict(enumerate(texts))
    for frame in frames:
        digits.append(len(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    assert len(frames) > 3 * places and max(digits) < 60
