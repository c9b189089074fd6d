import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with columns whose names operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1, "y") for i, t in rows], DOCS + ", digest string, tag int, row string")

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(3)
    words = ["ha", "re", "tion", "über", "ñmi", "the", "est", "idiot", "mit", "license", "中文", "x1"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (None, "no id here"), (None, None), (103, rows[5][1]), (104, rows[5][1] + "  "), rows[7], rows[7], (105, "long " * 30000 + "end")]
    return rows
