from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from apptledger.llm import bpe

from .conftest import ODD_TEXTS


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(bpe.default_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids, tokenizer


def random_texts(count: int) -> list[str]:
    rng = random.Random(7)
    pool = [chr(c) for c in [*range(0x250), *range(0x300, 0x520), *range(0x1E00, 0x2070), 0x1F600, 0xFEFF, 0x180E, 0x1100, 0x1161]]
    pool += [*"     aeiost'''019", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|END", "\n\n", "Σ"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(count)]


def test_same_ids_and_strings_as_the_library(spark, documents, library):
    encode, tokenizer = library
    texts = ODD_TEXTS + random_texts(1500)
    rows = bpe.decode(bpe.encode(documents(list(enumerate(texts))))).collect()
    assert len(rows) == len(texts)
    for row in rows:
        expected = encode(texts[row.doc_id])
        assert row.ids == expected
        assert row.decoded == tokenizer.decode(expected, skip_special_tokens=False)


def test_every_code_point(library):
    """Classes and small letters are those of the library, also where this Python's tables are older or newer."""
    tokenizer = bpe.tokenizer(bpe.default_path())
    texts = [f"a{chr(c)}b 1{chr(c)}" for c in bpe.POINTS]
    expected = library[1].encode_batch(texts, add_special_tokens=False)
    different = [c for c, text, e in zip(bpe.POINTS, texts, expected, strict=True)
                 if bpe.np.frombuffer(tokenizer.encode(text), "i4").tolist() != e.ids]
    assert different == []
    beyond = [0x40000, 0x8FFFF, 0xE01FF + 1, 0xF0000, 0x10FFFF]
    assert all(bpe.np.frombuffer(tokenizer.encode(f"x{chr(c)}y"), "i4").tolist() == library[0](f"x{chr(c)}y") for c in beyond)


def test_merges_skip_stale_entries():
    tokenizer = bpe.tokenizer(bpe.default_path())
    # A queue entry for a pair whose symbols were merged elsewhere must not be used.
    for word in ("aaaa", "ininin", "thththth", "banana" * 40):
        symbols = [tokenizer.inner[b] for b in word.encode()[:-1]] + [tokenizer.last[ord(word[-1])]]
        merged = tokenizer.merge(list(symbols))
        assert "".join(tokenizer.strings[i] for i in merged) == word + "</w>"


def test_ids_that_are_none(spark):
    rows = spark.createDataFrame([(None,), ([],), ([0, None, 10**6, -1, 1],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(rows).collect()] == ["", "", '! "']


def test_clashing_columns_repeats_and_empty(spark, documents):
    docs = documents([(1, "one two"), (1, "one two"), (None, None)]).withColumn("ids", F.lit("old"))
    rows = bpe.encode(docs).collect()
    assert [r.doc_id for r in rows] == [1, 1, None] and rows[0].ids == rows[1].ids and rows[2].ids == []
    assert bpe.decode(bpe.encode(docs.limit(0))).collect() == []


def test_a_full_cache_changes_nothing(monkeypatch):
    tokenizer = bpe.WordBpe(bpe.default_path())
    texts = random_texts(200)
    before = [tokenizer.encode(t) for t in texts]
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    assert [tokenizer.encode(t) for t in texts] == before
