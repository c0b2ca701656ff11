from __future__ import annotations

import pytest

WIDE = "doc_id long, text string, lang string, source string, n_chars long, n_words long, fp long, host string, words string"


def prose(seed: int, n: int) -> str:
    """Invented words that repeat with a period no passage reaches."""
    return " ".join(f"w{(i * i * 31 + seed * 7919 + i * seed) % 99991}" for i in range(n))


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text) with extra columns whose names the operators use."""

    def make(rows):
        wide = [(d, t, "en", "s", 0, -1, -1, "h", "w") for d, t in rows]
        return spark.createDataFrame(wide, WIDE)

    return make
