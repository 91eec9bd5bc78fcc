import random

import pytest

ODD_COLUMNS = ["id", "a", "b", "n", "key", "head", "place", "row", "fold", "score", "piece", "length", "group", "start", "end", "rule", "host", "path", "bad"]


@pytest.fixture(scope="session")
def words_of():
    """Made-up words, the same for one seed."""

    def of(seed: int, n: int) -> list[str]:
        rng = random.Random(seed)
        parts = ["ba", "co", "du", "fe", "gi", "lo", "mu", "ne", "pa", "ri", "so", "tu"]
        return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]

    return of


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table of (doc_id, text), with columns whose names the operators use inside."""

    def of(rows: list[tuple]):
        extra = ", ".join(f"`{c}` string" for c in ODD_COLUMNS)
        full = [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), *(["x"] * len(ODD_COLUMNS))) for i, t in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")

    return of


@pytest.fixture(scope="session")
def odd_rows(words_of):
    """Nulls, empty and blank texts, ties, repeated rows, very long texts."""
    long = " ".join(words_of(5, 60_000))
    same = " ".join(words_of(6, 80))
    return [(1, None), (2, ""), (3, " \n\t "), (4, same), (5, same), (5, same), (6, "one"), (7, "a b"), (8, long), (9, long + " tail"), (10, "ünï ÇÖ 😀 ́x")]
