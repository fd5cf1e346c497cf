from __future__ import annotations

import random

import pytest

from apptledger.llm import neardup

from .conftest import ODD_TEXTS


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute_force(rows):
    """Component of each id, over all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    name = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets.items():
            for j, b in sets.items():
                if i < j and a and b and 100 * len(a & b) >= 85 * len(a | b) and name[i] != name[j]:
                    name[i] = name[j] = min(name[i], name[j])
                    changed = True
    return {i: (len(s), name[i], name[i] == i) for i, s in sets.items()}


def copies(seed=4):
    """Originals, exact copies, copies with some words changed, and unrelated texts over common passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    passage = " ".join(rng.choices(vocabulary, k=80))
    texts = []
    for group in range(20):
        base = rng.choices(vocabulary, k=rng.choice([6, 7, 80, 200]))
        for _ in range(rng.choice([2, 5, 10])):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
        texts.append(passage + " " + " ".join(rng.choices(vocabulary, k=60 + group)))
    return texts + texts[:5]


def verdicts(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("block", [512, 3])
def test_same_components_as_all_pairs(spark, documents, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = list(enumerate(copies(), start=100))
    random.Random(1).shuffle(rows)
    expected = brute_force(rows)
    assert sum(not kept for *_, kept in expected.values()) > 20
    assert verdicts(neardup.near_duplicates(documents(rows))) == expected


def test_same_when_nothing_is_broadcast(spark, documents, shuffled_joins):
    rows = list(enumerate(copies(9)))
    assert verdicts(neardup.near_duplicates(documents(rows))) == brute_force(rows)


def test_a_large_group_of_near_copies(spark, documents):
    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(700):  # more than a block holds
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    assert verdicts(neardup.near_duplicates(documents(rows))) == brute_force(rows)


def test_odd_rows(spark, documents):
    rows = list(enumerate(ODD_TEXTS))
    got = verdicts(neardup.near_duplicates(documents(rows)))
    assert got == brute_force(rows)
    assert neardup.near_duplicates(documents([])).collect() == []
    # Without an id nothing is linked; repeated rows share a class.
    mixed = neardup.near_duplicates(documents([(None, "a b c"), (5, "a b c"), (5, "a b c"), (4, "A b  c"), (5, "z")])).collect()
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in mixed), key=str)
    assert found == sorted([(None, None, True), (5, 4, False), (5, 4, False), (4, 4, True), (5, 5, True)], key=str)


def test_one_document_of_each_group_stays(spark, documents):
    rows = list(enumerate(copies(3)))
    docs = documents(rows + rows[:2])
    stayed = neardup.deduplicated(docs)
    assert stayed.columns == docs.columns
    assert sorted(r.doc_id for r in stayed.collect()) == sorted(i for i, (_, _, kept) in brute_force(rows).items() if kept)


def test_a_text_of_its_own_stays_whatever_bears_its_id(spark, documents):
    copy, own = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, copy), (2, copy), (2, own), (2, own), (3, own + " more"), (4, ""), (4, " "), (4, None), (5, "a"), (5, "A"), (None, copy), (None, copy)]
    got = [(r.doc_id, r.text) for r in neardup.deduplicated(documents(rows)).collect()]
    assert len(got) == 7 and {i: sum(k == i for k, _ in got) for i in (1, 2, 3, 4, 5, None)} == {1: 1, 2: 1, 3: 0, 4: 2, 5: 1, None: 2}
    assert (2, own) in got and (4, " ") in got


def test_signature_halves_estimate_similarity():
    """Least and greatest values agree as often as the sets overlap."""
    rng = random.Random(6)
    agreed, expected = [], []
    for _ in range(60):
        common = [rng.getrandbits(64) for _ in range(300)]
        a, b = (neardup.np.array(sorted(common + [rng.getrandbits(64) for _ in range(100)]), neardup.np.uint64) for _ in range(2))
        agreed.append((neardup.signature(a) == neardup.signature(b)).mean())
        expected.append(300 / 500)
    assert abs(sum(agreed) / 60 - sum(expected) / 60) < 0.02
