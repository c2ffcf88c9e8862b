import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, component_id long, th long, kept boolean, taken long, _row int"


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with results."""
    import random

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    prose = lambda n, at=0: " ".join(words[(at + 7 * i + i * i) % 4000] for i in range(n))
    base = prose(120, 5)
    lines = "\n".join(prose(12, 50 * i) for i in range(8))
    rows = [
        (1, base),
        (2, base),
        (3, base.replace(" ", "  ", 3)),
        (4, base.rsplit(" ", 10)[0]),
        (5, None),
        (6, ""),
        (7, " \n\t "),
        (8, "one"),
        (9, "One"),
        (10, lines),
        (11, "an extra line\n" + lines),
        (12, prose(20_000, 11)),
        (12, prose(60, 900)),
        (13, "Ünïcödé ▁ \x00 日本語 😀 " * 20),
        (14, "x" * 300),
        (15, "x" * 300),
        (16, "a b c " * 60),
        (None, base),
        (None, prose(55, 77)),
        (17, prose(55, 77)),
        (17, prose(55, 77)),
    ]
    made = [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None if t is None else len(t), 1, 2, 3, True, 4, 5) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(made, DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
