"""Small corpora with everything that a corpus can hold."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

WORDS = ["alpha", "Beta", "gamma", "delta", "straße", "École", "eta", "theta", "iota", "kappa", "x1", "…", "ÄRGER"]


def prose(seed, n, words=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(n))


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(w if r.random() > share else f"new{r.randint(0, 999)}" for w in text.split(" "))


@pytest.fixture(scope="session")
def corpus():
    """``(doc_id, text)`` rows: copies, near copies, shared passages, empty, null and long texts, repeated rows."""
    base, passage = prose(1, 300), prose(2, 60)
    rows = [(i, edited(base, i, 0.02 * (i % 6))) for i in range(30)]
    rows += [(100 + i, prose(100 + i, 40) + " \t\n" + passage + "\x0b " + prose(200 + i, 30)) for i in range(12)]
    rows += [(200 + i, base.upper() if i % 2 else base) for i in range(10)]
    rows += [(300, None), (301, ""), (302, " \n "), (303, "one two"), (304, "One two"), (305, "a b c d e"), (306, None)]
    rows += [(400, prose(7, 30_000)), (401, prose(7, 30_000)), (402, "ab" * 400), (403, "word " * 500), (404, "x" * 5000)]
    rows += [(500, prose(9, 80)), (500, prose(9, 80)), (-3, prose(9, 80)), (501, "\x1f\x85 no ascii space")]
    return rows


@pytest.fixture
def documents(spark):
    def make(rows, **more):
        """A table with extra columns whose names operators use themselves."""
        schema = "doc_id long, text string, lang string, source string, n_chars long, value string, name string, n_tokens string, ids string, row string, component string, match_key string"
        full = [(d, t, "en", f"s{(d or 0) % 3}", len(t or ""), "v", "n", "t", "i", "r", "c", "k") for d, t in rows]
        return spark.createDataFrame(full, schema)

    return make

