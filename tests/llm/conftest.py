import os
import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SAMPLE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make_docs(spark):
    """make_docs([text, ...]) or make_docs([(id, text, lang, source), ...])."""

    def make(rows):
        full = []
        for n, r in enumerate(rows):
            doc_id, text, lang, source = r if isinstance(r, tuple) else (n, r, "en", "s")
            full.append((doc_id, text, lang, source, len(text) if text is not None else None))
        return spark.createDataFrame(full, SCHEMA)

    return make


def prose(seed: int, words: int) -> str:
    """Invented sentences."""
    rng = random.Random(seed)
    out = []
    for n in range(words):
        w = "".join(rng.choice(["th", "on", "er", "in", "ré", "ß", "qu", "a"]) for _ in range(rng.randint(1, 4)))
        out.append(w + (rng.choice([". ", ".\n", "! "]) if rng.random() < 0.15 else " "))
    return "".join(out).strip()


# Nulls, empty and blank texts, no letters, repeated rows, a null id, a very long text.
AWKWARD = [
    (1, prose(1, 120), "en", "a"),
    (2, prose(2, 60), None, None),
    (3, None, "en", "a"),
    (4, "", "de", "b"),
    (5, " \t\n ", "de", "b"),
    (6, "123 -- !!", "de", "b"),
    (7, prose(1, 120), "en", "a"),
    (7, prose(1, 120), "en", "a"),
    (None, prose(3, 50), "fr", None),
    (8, prose(4, 20_000), "fr", "c"),
    (9, "x" * 50_000, "fr", "c"),
    (10, "日本語 text 🎉 é\x00 end", "en", "c"),
]


@pytest.fixture(scope="session")
def awkward(make_docs):
    return make_docs(AWKWARD)


@pytest.fixture(scope="session")
def nothing(make_docs):
    return make_docs([])


needs_data = pytest.mark.skipif(not os.path.isdir(SAMPLE), reason="test tables not present")
