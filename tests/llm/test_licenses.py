from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from apptledger.llm import licenses

from .conftest import ODD_TEXTS


def brute_force(text, templates, threshold=licenses.THRESHOLD):
    """All passages against all templates, without bounds."""
    text = text or ""
    found = []
    for passage in {*text.split("\n"), *re.split(r"\n[ \t\r]*\n", text), text}:
        p = set(licenses.bigrams_of(passage))
        for name, body in templates.items():
            t = set(licenses.bigrams_of(body))
            if p and t and 2 * len(p & t) / (len(p) + len(t)) >= threshold:
                found.append((2 * len(p & t) / (len(p) + len(t)), len(p), name, passage))
    return sorted(found, key=lambda m: (-m[0], -m[1], m[2]))


def samples():
    rng = random.Random(2)
    bodies = list(licenses.TEMPLATES.values())
    out = [t for t in ODD_TEXTS if len(t or "") < 2000]
    for _ in range(150):
        lines = []
        for _ in range(rng.randrange(4)):
            words = rng.choice(bodies).split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(["license", "x", "the", "software,"])
            line = " ".join(words)
            lines.append(rng.choice([line, line.upper(), line.replace(" ", "*** "), "\n".join(words), line[: len(line) // 2]]))
        out.append(rng.choice(["\n", "\n\n", "\n \t\n", " "]).join(["Plain prose of the day.", *lines]))
    return out


def test_same_matches_as_all_pairs(spark, documents):
    texts = samples()
    rows = licenses.scan(documents(list(enumerate(texts)))).collect()
    assert len(rows) == len(texts) and sum(bool(r.matches) for r in rows) > 50
    for row in rows:
        got = [(m.dice, m.n_bigrams, m.license, m.passage) for m in row.matches]
        expected = brute_force(texts[row.doc_id], licenses.TEMPLATES)
        assert sorted(got) == sorted(expected) and [m[:3] for m in got] == [m[:3] for m in expected]


def test_probe_words_lose_no_match():
    """Bigrams without any probe word are too few for a match, for any threshold and template."""
    for threshold in (0.5, 0.8, 0.95):
        probes = set(licenses.probe_words(licenses.TEMPLATES, threshold))
        for body in licenses.TEMPLATES.values():
            pairs = licenses.bigrams_of(body)
            free = [p for p in pairs if not probes & set(p.split(" "))]
            assert not free or len(free) < threshold / (2 - threshold) * len(pairs)


def test_own_templates_and_long_texts(spark, documents):
    templates = {"own": "alpha beta gamma delta", "single": "alpha", "none": ""}
    rows = {r.doc_id: r.matches for r in licenses.scan(documents([
        (1, "Alpha, BETA gamma: delta"), (2, "word " * 50_000 + "\nalpha beta gamma delta\n" + "word " * 50_000), (3, "alpha")]),
        templates=templates).collect()}
    assert [m.license for m in rows[1]] == ["own"] and [m.license for m in rows[2]] == ["own"] and rows[3] == []
    assert licenses.scan(documents([(1, "a b")]), templates={}).first().matches == []


def test_no_python_in_the_plan_and_odd_tables(spark, documents):
    docs = documents([(None, None), (1, "All rights reserved"), (1, "All rights reserved")]).withColumn("matches", F.lit(0))
    scanned = licenses.scan(docs)
    plan = scanned._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert [len(r.matches) for r in scanned.collect()] == [0, 1, 1]
    assert licenses.scan(docs.limit(0)).collect() == []
