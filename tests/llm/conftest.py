from __future__ import annotations

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A table like ``documents`` from (id, text) pairs."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOCUMENT)

    return make


#: Shapes that every operator on texts has to take.
ODD_TEXTS = [
    None, "", " ", "\n\n", "a", "word", "\x00\x1c\x1f", "x" * 60_000, "ab " * 30_000, "é" * 500, "\U0001f600 ퟿",
    "Same text here.", "Same text here.", "'s 'LL don't", "ΣΑΣ İẞ ́",
]
