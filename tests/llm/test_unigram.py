from __future__ import annotations

import random

from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer, models

from apptledger.llm import unigram

from .conftest import ODD_TEXTS


def library():
    """The same vocabulary as the library's own unigram model."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(unigram.default_path(), "rb") as file:
        model.ParseFromString(file.read())
    tokenizer = Tokenizer(models.Unigram([(p.piece, p.score) for p in model.pieces], 0, True))
    return lambda text: len(tokenizer.encode("▁" + text.replace(" ", "▁")).tokens) if text else 0


def random_texts(count: int) -> list[str]:
    rng = random.Random(3)
    pool = [*"   abeest.,\n\t12", "the", "ing", *map(chr, range(0x20, 0x500)), "▁", "中", "\U0001f600", "\x00"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(count)]


def test_same_counts_as_the_library(spark, documents):
    expected, texts = library(), ODD_TEXTS + random_texts(1500)
    rows = unigram.token_counts(documents(list(enumerate(texts)))).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: expected(t) for i, t in enumerate(texts)}


def test_brute_force_best_score():
    model = unigram.vocabulary(unigram.default_path())

    def cuts(part):
        if not part:
            return [(0, 0)]
        ways = []
        for size in range(1, len(part) + 1):
            score = model.scores.get(part[:size])
            if score is not None:
                ways += [(s + score, n + 1) for s, n in cuts(part[size:])]
        return ways

    for part in ("▁the", "ering", "▁tion", "▁then", "abc"):
        best = max(s for s, _ in cuts(part))
        assert model.count_part(part) in {n for s, n in cuts(part) if s == best}


def test_empty_table_and_clashing_column(spark, documents):
    docs = documents([(1, "a b")]).withColumnRenamed("source", "n_tokens")
    assert unigram.token_counts(docs).collect()[0].n_tokens > 0
    assert unigram.token_counts(docs.limit(0)).collect() == []
