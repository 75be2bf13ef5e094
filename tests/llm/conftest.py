import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, taken string, row string, words string, h string"


def make_texts() -> list[str | None]:
    """Texts with shared passages, copies, near copies, repeats, junk, nulls and one long text."""
    draw = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzäßñ"
    words = ["".join(draw.choices(letters, k=draw.randint(2, 9))) for _ in range(1500)]

    def prose(n: int) -> str:
        return "\n".join(" ".join(draw.choices(words, k=draw.randint(5, 14))).capitalize() + "." for _ in range(n))

    texts: list[str | None] = [prose(draw.randint(1, 14)) for _ in range(60)]
    shared = prose(6)
    texts += [prose(2) + "\n" + shared + "\n" + prose(2) for _ in range(5)] + [texts[3], texts[3], texts[7]]
    for base in (texts[10], texts[11], shared):
        for _ in range(3):
            parts = base.split(" ")
            parts[draw.randrange(len(parts))] = draw.choice(words)
            texts.append(" ".join(parts))
    texts += ["", None, " \t\n\n ", "x", "a b c d", "a" * 450, "no no no " * 60, "eins zwei\n" * 50, "UPPER Case " * 3, prose(400)]
    return texts


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Extra columns bear names that the operators use; one row is repeated, with the last doc_id."""
    rows = [(i * 3, t, "en", None if i % 11 == 0 else f"s{i % 4}", len(t or ""), "x", "y", "z", "w", "h") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1]], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def by_id(texts):
    return {i * 3: t for i, t in enumerate(texts)}


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, ties and repeated rows."""
    return spark.createDataFrame([(None,) * 10, (None,) * 10, (4, None) + (None,) * 8, (4, None) + (None,) * 8, (5, "word", None, None, None) + ("c",) * 5], SCHEMA)
