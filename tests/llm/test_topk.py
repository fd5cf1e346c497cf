from __future__ import annotations

import math
import random

import pytest

from apptledger.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, k=5):
    vectors = {}
    for number, vector, *_ in rows:
        if number is not None and vector and all(x is not None and math.isfinite(x) for x in vector):
            vectors.setdefault(number, set()).add(tuple(math.floor(256 * float(x)) for x in vector))
    out = []
    for q in sorted(v for v in vectors if v % 50 == 0):
        scores = {}
        for a in vectors[q]:
            for c, many in vectors.items():
                for b in many if c != q else ():
                    if len(a) == len(b):
                        scores[c] = max(scores.get(c, -2**63), sum(x * y for x, y in zip(a, b, strict=True)))
        ranked = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k]
        out += [(q, i + 1, c, s) for i, (c, s) in enumerate(ranked)]
    return out


def found(spark, rows, **options):
    vectors = spark.createDataFrame(rows, SCHEMA)
    got = topk.search(vectors.where("vec_id % 50 = 0"), vectors, **options).collect()
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got)


def single(x):
    """As a 32-bit number."""
    return topk.np.float32(x).item()


def vectors(count, dim, seed, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    rows = []
    for i in range(count):
        scale, centre = rng.lognormvariate(0, spread), rng.choice(centres)
        rows.append((i, [single(scale * (c + rng.gauss(0, 0.3))) for c in centre], 0))
    return rows


@pytest.mark.parametrize(("bucket", "block", "spread"), [(4096, 512, 1.0), (16, 4, 1.5), (16, 4, 0.0)])
def test_same_as_all_products(spark, monkeypatch, bucket, block, spread):
    monkeypatch.setattr(topk, "BUCKET", bucket)
    monkeypatch.setattr(topk, "BLOCK", block)
    rows = vectors(400, 8, 1, spread)
    rows += [(1000 + i, rows[0][1], 0) for i in range(40)]  # ties
    assert found(spark, rows) == brute_force(rows)


def test_odd_vectors(spark):
    rows = vectors(60, 4, 2)
    rows += [(100, None, 0), (150, [], 0), (200, [1.0, None, 0.0, 0.0], 0), (250, [math.nan, 0.0, 0.0, 0.0], 0),
             (300, [math.inf, 0.0, 0.0, 0.0], 0), (350, [0.0] * 4, 0), (400, [0.0] * 4, 0), (None, [1.0] * 4, 0),
             (450, [1.0, 2.0], 0), (451, [-1.0, 2.0], 0), (500, [5.0], 0), rows[0], rows[50], (0, [9.0, 9.0, 9.0, 9.0], 1)]
    assert found(spark, rows) == brute_force(rows)


def test_fewer_candidates_than_asked(spark):
    rows = [(0, [1.0, 2.0], 0), (1, [-3.0, 1.0], 0), (50, [0.5, 0.0], 0)]
    assert found(spark, rows) == brute_force(rows) and len(found(spark, rows)) == 4
    assert found(spark, rows[:1]) == [] and found(spark, []) == []


def test_huge_components_are_exact(spark):
    rows = [(i, [single(x * 10.0 ** (i % 7)) for x in v], 0) for i, v, _ in vectors(120, 3, 5)]
    assert found(spark, rows) == brute_force(rows)


def test_pruning_leaves_rows_out():
    """With bounds of a real search, coordinates rule out most rows of a bucket."""
    rows = topk.np.floor(256 * topk.np.array([v for _, v, _ in vectors(2000, 8, 3, 0.0)]))
    bucket = topk.Bucket(topk.np.arange(len(rows)), rows)
    left = []
    for query in rows[:50]:
        scores = topk.np.sort(rows @ query)
        norm = float(topk.np.sqrt(query @ query))
        near = bucket.near(query, norm, float(scores[-6]))
        assert near is None or set(topk.np.argsort(-(bucket.rows @ query))[:5]) <= set(near)
        left.append(1.0 if near is None else len(near) / len(rows))
    assert sum(left) / len(left) < 0.8
