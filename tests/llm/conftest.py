import random

import pytest

WORDS = [f"w{i}" for i in range(400)]
#: Columns that the operators use themselves, with other meanings.
CLASHES = "leader BIGINT, group_id STRING, shard STRING, score STRING, lines INT, text_hash STRING, gone STRING, words STRING, bucket STRING, cell STRING, piece STRING, n STRING, page STRING, template STRING, listed STRING, toxic STRING, __gone STRING, __id STRING"
SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, " + CLASHES


def prose(seed: int, n: int, width: int = 12) -> str:
    r = random.Random(seed)
    words = [r.choice(WORDS) + r.choice(("", "", ".", ",")) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, n, width))


def row(i, text):
    return (i, text, "en", "s", None if text is None else len(text), *([None] * 18))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns of clashing names."""
    long = prose(9, 60_000)
    rows = [row(None, None), row(None, prose(1, 80)), row(1, None), row(2, ""), row(3, "   \n\n "), row(4, prose(1, 80)), row(5, prose(1, 80)), row(5, prose(1, 80)), row(6, "one"), row(7, "one"), row(8, long), row(9, long + " more words here"), row(10, prose(3, 60)), row(10, prose(4, 60)), row(11, "é" * 300), (12, prose(5, 90), None, None, None, *([None] * 18))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
