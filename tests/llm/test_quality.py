from __future__ import annotations

import random
import re

import zstandard

from apptledger.llm import quality

from .conftest import ODD_TEXTS


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeated(words):
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered.update(range(i, i + 8))
    return len(covered)


def duplicates(text):
    lines = (text or "").split("\n")
    return sum(bool(words_of(line)) and line in lines[:i] for i, line in enumerate(lines))


def samples():
    rng = random.Random(5)
    texts = [t for t in ODD_TEXTS if len(t or "") < 1000]
    vocabulary = ["alpha", "beta", "gamma", "#x", "<b>", "delta\n", "\x0b", "é%"]
    for size in (5, 20, 60, 200):
        texts += [" ".join(rng.choice(vocabulary[:rng.randint(1, 8)]) for _ in range(size)) for _ in range(12)]
    return texts


def test_base_measures_by_brute_force(spark, documents):
    texts = samples()
    rows = quality.judged(documents(list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text, words = texts[row.doc_id], words_of(texts[row.doc_id])
        assert (row.n_words, row.word_chars) == (len(words), sum(map(len, words)))
        assert row.n_symbols == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert row.n_dup_lines == duplicates(text)
        assert row.n_repeat_words == repeated(words)
        assert row.base_failed == (len(words) < 20 or 100 * repeated(words) > 30 * len(words))
        assert not (row.base_failed and row.kept)
        data = (text or "").encode()
        assert row.n_bytes == len(data) and row.n_packed == len(zstandard.ZstdCompressor(level=3).compress(data))


def prose(rng, size):
    """Words whose frequency falls with their rank, as in a language."""
    stems = ["".join(rng.choice("aeioubcdlmnprst") for _ in range(rng.randint(2, 9))) for _ in range(20_000)]
    return " ".join(stems[int(20_000 ** rng.random()) - 1] for _ in range(size))


def test_verdicts(spark, documents):
    rng = random.Random(1)
    noise = " ".join("".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(6)) for _ in range(2000))
    long = prose(rng, 20_000)
    texts = {
        "short prose": prose(rng, 40), "prose": prose(rng, 600), "long prose": long,
        "packed": "".join(rng.choice("0123456789abcdef") + (" " if i % 9 == 0 else "") for i in range(30_000)),
        "noise": noise, "half repeated": prose(rng, 3000) + " lorem ipsum dolor sit amet consectetur" * 4000,
        "one word": "word " * 5000, "none": None,
    }
    names = list(texts)
    rows = {names[r.doc_id]: r for r in quality.judged(documents([(i, texts[n]) for i, n in enumerate(names)])).collect()}
    assert rows["short prose"].kept and rows["prose"].kept and rows["long prose"].kept
    for name in ("half repeated", "one word", "none"):
        assert not rows[name].kept
    assert rows["half repeated"].n_bad_chunks > 0


def test_rows_and_columns_stay(spark, documents):
    docs = documents([(1, "a b " * 3), (1, "a b " * 3), (None, None)]).withColumnRenamed("lang", "n_words")
    assert quality.judged(docs).count() == 3
    assert quality.kept(docs.drop("n_words")).columns == docs.drop("n_words").columns
    assert quality.judged(docs.limit(0)).collect() == []
