import random

import pytest

#: Columns whose names the operators use inside, and some that need quoting.
CLASHES = "uid string, digest string, norm string, spans string, label string, node string, part string, text_hash string, key string, score string, kept string, n string, `a.b` string, `w``x` string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
N_CLASHES = 14


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", None if text is None else len(text), *["x"] * N_CLASHES)


@pytest.fixture(scope="session")
def edge_rows():
    long = " ".join(words(60_000, 1, 5000))
    plain = " ".join(words(120, 2))
    near = plain.split()
    near[60] = "edited"
    return [
        row(1, plain),
        row(2, None, None),
        row(3, ""),
        row(4, " \t\r\n "),
        row(5, long),
        row(6, long + " tail"),
        row(7, plain.replace(" ", "  ")),
        row(7, plain.replace(" ", "  ")),
        row(8, " ".join(near)),
        row(None, plain, None),
        row(9, "short text"),
        row(10, "😀 ß é\n12 12\n12 12", "de"),
        row(11, "x" * 100_000),
        row(12, "▁ mark ▁▁ and line"),
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    schema = "doc_id long, quality int, toxic int, text string, label string"
    return spark.createDataFrame([(1, 1, 0, "t", "l"), (5, 1, None, "t", "l"), (8, 0, 1, "t", "l"), (8, 1, 1, "t", "l"), (None, 1, 1, "t", "l"), (99, None, 0, "t", "l")], schema)
