import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, piece string, salt string, component string, kept string, taken int"


@pytest.fixture
def frame(spark):
    """Documents with further columns whose names operators use themselves."""

    def make(rows):
        full = [(d, t, lang, source, len(t) if t is not None else None, -1, "p", "s", "c", "k", 0) for d, t, lang, source in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def odd_rows():
    """Null and empty texts, a null id, repeated rows, ties, a long text, null languages and sources."""
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 9))) for _ in range(300)]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    base = text(120)
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, base, "en", "a"), (4, base.upper(), None, "b"), (5, base, "en", "a"), (5, base, "en", "a"), (6, " \t\n ", "fr", "b"), (7, text(20_000), "fr", "b"), (8, "one two three", "fr", "b"), (9, "Ünïcödé ☃ \u00a0 text", "de", "c"), (None, text(70), "de", "c")]
    return rows + [(10 + i, text(60 + i), "de", "abc"[i % 3]) for i in range(20)]
