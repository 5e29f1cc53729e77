import random

import pytest

ODD_DOCS = "doc_id long, text string, lang string, source string, n_chars long, id int, key string, label int, keeper string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing columns."""
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("ba", "ko", "ri", "tu", "ne") for b in ("lan", "mor", "sti", "ve", "pol")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = {i: prose(rng.choice([3, 40, 120])) for i in range(12)}
    texts |= {20: None, 21: "", 22: " \n\t ", 23: "12 34 !?", 24: prose(40_000), 25: texts[1], 26: texts[2] + " extra", 27: "É" * 3000, 28: "x"}
    rows = [(i, t, None if i == 3 else "aa", None, None, 1, "k", 2, "z") for i, t in texts.items()]
    rows += [rows[0], rows[0], (None, texts[4], None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, ODD_DOCS)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
