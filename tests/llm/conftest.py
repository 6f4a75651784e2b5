import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tokens string, digest string, _text string, severity double, `set` int"


@pytest.fixture(scope="session")
def prose():
    """Seeded sentences: prose(seed, words)."""

    def make(seed: int, words: int) -> str:
        rng = random.Random(seed)
        parts = ["".join(rng.choice(["an", "er", "th", "on", "re", "st", "in", "ou"]) for _ in range(rng.randint(2, 4))) for _ in range(words)]
        return " ".join(parts)

    return make


@pytest.fixture(scope="session")
def table(spark):
    """(doc_id, text[, lang[, source]]) rows as documents with more columns, whose names operators use themselves."""

    def build(rows):
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, None, None)[:4]
            full.append((doc_id, text, lang, source, None if text is None else len(text), "x", None, "y", 1.0, 7))
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def edge(prose):
    """Null, empty, blank, one-word, very long and repeated texts; null, repeated and far ids."""
    same = prose(1, 80)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "Word"), (5, prose(5, 4)), (6, prose(6, 60_000)), (7, same), (7, same), (8, same), (8, prose(8, 70)),
        (None, same), (None, None), (-(2**62), prose(9, 100)), (2**62, "Été naïve 中文 \U0001f600 end"),
    ]
