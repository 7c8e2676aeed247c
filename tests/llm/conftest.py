import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, score double, node long, size long, n_lines int, lost int"
#: Null, empty and white-space texts, a null id, repeated rows, ties, and characters of all kinds.
EDGES = [
    (1, None), (2, ""), (3, " \t\n\x0b "), (None, "a null id has this text of eight words"), (5, "repeated rows are here"), (5, "repeated rows are here"), (6, "repeated  rows\tare here "),
    (7, "ünïcödé 日本語 \U0001f600 words, and a longer tail of them"), (8, "line one is long enough\nline two is long enough\n\nline one is long enough"), (9, "LINE ONE is long enough  \nother words"), (10, "x"), (None, None), (11, "end\n"), (12, "\x1c odd \x85 spaces \xa0 stay"),
]


def as_docs(spark, rows):
    """Documents with further columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 7 else None, len(t or ""), "r", 1, 0.5, 7, 9, 3, None) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="session")
def edges(spark):
    return as_docs(spark, EDGES)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def near_copies(seed=1, groups=6, copies=7, words=60):
    """Documents in chains of edits, exact copies, and others of many sizes."""
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = prose(rng, words + rng.randrange(200)).split()
        for _ in range(copies):
            rows.append(" ".join(base))
            for _ in range(rng.choice((0, 1, 1, 2, 3))):
                base[rng.randrange(len(base))] = f"e{rng.randrange(10**6)}"
    rows += [prose(rng, n) for n in list(range(0, 40)) * 2]
    short = prose(rng, 12).split()
    rows += [" ".join(short[:n]) for n in range(13)] * 2
    rng.shuffle(rows)
    return list(enumerate(rows))
