import random

import pytest

WORDS = "the of and river stone light green quiet under cloud seven paper winter garden motion silver letter window".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) + str(rng.randrange(40)) for _ in range(n))


def edge_rows():
    """Nulls, blanks, copies, near copies, repeated rows and ids, long and odd texts."""
    long = prose(1, 6000)
    base = prose(2, 120)
    near = base.replace(base.split()[60], "changed", 1)
    shared = prose(3, 70)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, base, "en", "a"), (5, base, "en", "b"), (6, near, "en", "b"),
        (7, prose(4, 60) + " " + shared + " " + prose(5, 50), "en", "a"), (8, prose(6, 40) + "\n" + shared + "\n" + prose(7, 60), "de", "a"),
        (9, long, "en", "a"), (10, "ab" * 400, "en", "a"), (11, "same line here\n" * 40, "en", "a"), (12, base, "en", "a"), (12, base, "en", "a"),
        (13, prose(8, 30), "fr", "c"), (13, prose(9, 30), "fr", "c"), (None, base, "en", "a"), (None, prose(10, 50), "en", "a"),
        (14, "MIT License, Apache license; cc BY cc by x gnu GENERAL public license", "en", "a"),
        (15, "é" * 130 + " Ünïcode 😀 " + "é" * 130, "de", "b"), (16, "### $$$ %%% &&& " * 30, "en", "a"), (17, "word", "en", "a"),
        (18, prose(11, 40) + " " + prose(99, 30) + " " + prose(12, 40), "en", "a"), (19, "<|endoftext|> <|startoftext|> it's ΣΑΣ", "en", "a"),
    ]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark):
    """The rows above, with extra columns whose names the operators use themselves."""
    rows = [(*r, len(r[1] or ""), i, "x", 0.5, False) for i, r in enumerate(edge_rows())]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, label string, score double, kept boolean"
    ).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def vocab():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path
