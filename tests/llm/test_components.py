from __future__ import annotations

import random

from apptledger.llm.components import components


def test_random_graphs(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    links += [(1000 + i, 1001 + i) for i in range(60)]  # a path
    links += [(5000, 5001 + i) for i in range(200)] + [(7, 7)]  # a star and a loop
    parent = {n: n for pair in links for n in pair}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {n for a, b in links if a != b for n in (a, b)}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {n: find(n) for n in linked}
    assert len(got) == len(linked)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
