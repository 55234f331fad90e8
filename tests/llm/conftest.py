import os
import random

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    return SMALL


def nasty_texts() -> list:
    """Null, empty, blank, odd white space, repeated and long texts."""
    r = random.Random(3)
    words = ["alpha", "Beta,", "gamma.", "it's", "naïve", "ÉCOLE", "x1y2", "…", "東京", "don't", "--", "12.5"]
    texts = [None, "", " ", "\n\n", "a", " a", "a ", "a  b\n\n c", "tab\tb\x0bc", "nb sp  x", "<|endoftext|> y", "é combining", "́x y"]
    texts += [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(40)]
    texts += [r.choice([" ", "\n", "  "]).join(r.choice(words) for _ in range(3000)), texts[20], texts[20]]
    return texts


@pytest.fixture(scope="session")
def odd_docs(spark):
    """A table of awkward texts with a clashing extra column and a repeated row."""
    rows = [(i, t, "en", None, "kept") for i, t in enumerate(nasty_texts())]
    rows.append(rows[15])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, start string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
