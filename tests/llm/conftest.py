import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def random_text(rng: random.Random, words: int, vocabulary: int = 40) -> str:
    seps = [" ", " ", " ", "  ", "\n", "\t", " \n "]
    return "".join(rng.choice(["", "é", "Ж", "#", ""]) + f"w{rng.randrange(vocabulary)}" + rng.choice(seps) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Rows with nulls everywhere, empty, blank, long, repeated, multi-byte and control-character texts."""
    rng = random.Random(5)
    rows = [(i, random_text(rng, rng.randrange(0, 90)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), None, "x") for i in range(60)]
    rows += [(60, None, "en", "a", None, None), (61, "", "fr", "b", 0, None), (62, " \n\t\x0b", None, None, None, None), (None, "lonely w1 w2", "en", None, None, "y")]
    rows += [rows[3], (3, "another text under the id of three", "en", "a", 1, None), (63, random_text(rng, 30_000), "en", "a", None, None), (64, "x" * 5000, "en", "b", None, None)]
    rows += [(70 + i, rows[5][1], "fr", "ab"[i % 2], None, None) for i in range(4)] + [(80, "\x00a\x00 b\n\nc\n", "en", "a", None, None), (81, "日本 語 текст 123", None, "b", None, None)]
    return rows


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOC_SCHEMA).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
