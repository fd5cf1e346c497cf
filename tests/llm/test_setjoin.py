"""The n-gram join against a comparison of all pairs."""

from __future__ import annotations

import itertools
import random

import pytest

from apptledger.llm import queries, setjoin

from .conftest import ODD_TEXTS


def shingle_set(text):
    words = (text or "").encode("utf-8").lower().split()
    if 0 < len(words) < setjoin.SHINGLE:
        return {tuple(words)}
    return set(zip(*(words[k:] for k in range(setjoin.SHINGLE)), strict=False))


def brute_force(rows):
    """id -> (size, component), every row a node of its own."""
    sets, above = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 10 * min(len(a), len(b)) >= 9 * max(len(a), len(b)):
            both = len(a & b)
            if 100 * both >= 90 * (len(a) + len(b) - both):
                above[root(i)] = root(j)
    names = {}
    for i, (own, _) in enumerate(rows):
        names[root(i)] = min(names.get(root(i), own), own)
    return {own: (len(sets[i]), names[root(i)]) for i, (own, _) in enumerate(rows)}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.linked_documents(df).collect()}


def family(rng, size, members, edits):
    """Texts that differ from one another by a few words in places."""
    base = [rng.choice("abcdefghijklmnop") + str(rng.randrange(60)) for _ in range(size)]
    for _ in range(members):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(words) + 1)
            kind = rng.randrange(3)
            words[at:at + (kind > 0)] = [f"new{rng.randrange(40)}"] if kind < 2 else []
        yield " ".join(words)


def test_sizes_that_may_link():
    for a, b in itertools.product(range(1, 120), repeat=2):
        possible = any(100 * i >= 90 * (a + b - i) for i in range(min(a, b) + 1))
        assert (b in setjoin.partners(a) and setjoin.needed(a, b) <= min(a, b)) == possible
        if possible:
            least = next(i for i in range(min(a, b) + 1) if 100 * i >= 90 * (a + b - i))
            assert setjoin.needed(a, b) == least and a - least <= setjoin.missing(a)
    assert setjoin.LEAST == 9


@pytest.mark.parametrize("most", [8, 14, 24, None])
def test_families_of_all_sizes(spark, documents, monkeypatch, most):
    """Subsets only, lists only, and both; the boundary must not change a thing."""
    rng = random.Random(11)
    texts = [t for size in (3, 8, 10, 11, 12, 13, 15, 19, 22, 23, 30, 60, 150) for edits in (1, 2)
             for t in family(rng, size, 7, edits * (1 + size // 60))]
    passage = next(family(rng, 40, 1, 0))
    texts += [f"{t} {passage}" for t in family(rng, 20, 6, 1)] + [passage] * 3 + [f"own{i} {passage}" for i in range(9)]
    if most is not None:
        monkeypatch.setattr(setjoin, "boundary", lambda ordered: most)
    rows = list(enumerate(texts))
    expected = brute_force(rows)
    assert result(documents(rows).repartition(5)) == expected
    assert 20 < len({c for _, c in expected.values()}) < len(rows) - 60


def test_one_large_group_of_near_copies(spark, documents):
    """The chain of links holds where ends are far apart, and strangers with a common passage stay apart."""
    rng = random.Random(5)
    texts = list(family(rng, 120, 150, 4))
    words = [f"w{i}" for i in range(200)]
    for step in range(40):  # each five words further: neighbours are linked, ends have nothing in common
        words[5 * step:5 * step + 3] = [f"s{step}.{k}" for k in range(3)]
        texts.append(" ".join(words))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [" ".join(f"d{k}.{i}" for i in range(30)) + " " + passage for k in range(60)]
    rows = list(enumerate(texts))
    assert result(documents(rows).repartition(4)) == brute_force(rows)


def test_odd_texts_and_clashing_columns(spark, documents):
    rows = list(enumerate([*ODD_TEXTS, "one two", "ONE  two", "one two three", "x" * 20 + " y z"]))
    df = documents(rows).withColumnRenamed("lang", "class").withColumnRenamed("source", "n_shingles")
    assert result(df) == brute_force(rows)
    assert setjoin.linked_documents(df.limit(0)).count() == 0
    assert setjoin.linked_documents(df).columns == ["doc_id", "n_shingles", "component_id"]


def test_rows_without_or_with_repeated_ids(spark, documents):
    long = " ".join(f"w{i}" for i in range(40))
    got = setjoin.linked_documents(documents([(7, long), (7, long), (None, long), (3, long + " more"), (7, "other text")])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [
        (0, 38, 0), (3, 39, 3), (7, 1, 7), (7, 38, 3), (7, 38, 3)]


def test_chunks_do_not_matter(spark, documents, monkeypatch):
    rng = random.Random(3)
    rows = list(enumerate(t for size in (12, 40, 90) for t in family(rng, size, 12, 2)))
    df, expected = documents(rows).repartition(3), brute_force(rows)
    monkeypatch.setattr(setjoin, "CHUNK", 50)
    monkeypatch.setattr(setjoin, "PART", 100)
    assert result(df) == expected


def test_shuffled_joins(shuffled_joins, documents):
    rng = random.Random(4)
    rows = list(enumerate(t for size in (12, 40, 90) for t in family(rng, size, 20, 2)))
    assert result(documents(rows)) == brute_force(rows)


def test_the_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op13_set_join(spark, sf_dir).collect()}
    assert got == brute_force(sorted(rows)) and any(c != i for i, (_, c) in got.items())
