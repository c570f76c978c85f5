import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, odd white space and control strings."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["th", "on", "er", "é", "ß", "an", "ing"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    texts = [
        None, "", " ", "\n\n", "  two  spaces ", "a\tb\x0bc\x1fd e", "x <|endoftext|> y", "▁mark ▁ here", "💙 ﬁ　wide",
        prose(5), prose(60), prose(400), prose(9000), "word " * 300, "Home | About | News | Terms\n" * 20, "no spaces" * 3000,
        "\n".join(prose(12) for _ in range(10)), "STOP!! NOW!! GO!! AWAY!! " * 15,
    ]
    rows = [(i, t, ["en", "de", None][i % 3], ["b", "a", None, "c"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [(100, texts[11], "en", "a", 1), (100, texts[11], "en", "a", 1), (101, texts[11], None, None, None), (None, prose(80), "en", "b", 3), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
