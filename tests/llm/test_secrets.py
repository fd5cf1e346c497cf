from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from apptledger.llm import secrets

from .conftest import ODD_TEXTS

SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
RANDOM = "qX7dP0vZr93kTmB1wYc8LhQe5sJu2NfG"


def base(text):
    """The fixed kinds, as told: match greedily, then drop what is too short."""
    text = text or ""
    assign = re.compile("(?:" + "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w) for w in (
        "password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def texts():
    rng = random.Random(4)
    bits = ["password", "PassWD", "secret", "token", "apikey", "API_KEY", ":", "=", " ", '"', "'", "abcdef", "x-1.2/3+4",
            "AKIA", "AKIA" + "Q7" * 8, "deadbeef" * 3, "deadbeef" * 2, "\u017fecret", "to\u212aen", "\n", "é", "😀"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(800)]


def test_base_spans_by_brute_force(spark, documents):
    given = ODD_TEXTS + texts()
    rows = secrets.scan(documents(list(enumerate(given)))).collect()
    assert len(rows) == len(given)
    for row in rows:
        spans = [(s.start, secrets.KINDS.index(s.kind), s.end) for s in row.spans]
        assert spans == sorted(spans)
        assert [s for s in spans if s[1] < 3] == base(given[row.doc_id])


def kinds(spark, documents, text):
    row = secrets.scan(documents([(1, text)])).first()
    return [(s.kind, text[s.start:s.end]) for s in row.spans]


def test_random_strings_stand_out(spark, documents):
    assert kinds(spark, documents, f"é see {RANDOM} here") == [("random", RANDOM)]
    assert kinds(spark, documents, f"url https://host/{RANDOM}/x") == [("random", RANDOM)]


def test_known_strings_do_not(spark, documents):
    for text in (
            f"sha256:{SHA256.upper()}", "550e8400-e29b-41d4-a716-446655440000", "internationalization2024conference",
            "Donaudampfschifffahrtsgesellschaftskapitaen", "getUserAccountPreferencesFromDatabase", "1234567890123456789012345678",
            "https://example.com/articles/the-quick-brown-fox-jumps-over-the-lazy-dog", "=" * 80, "-" * 60, "a" * 5000):
        assert [k for k, _ in kinds(spark, documents, text) if k == "random"] == [], text


def test_masking(spark, documents):
    rows = ODD_TEXTS + [f"a {RANDOM} b", f'token = "{RANDOM}" end', f"{'ab12' * 6}{RANDOM}", f"{RANDOM}", f"x {RANDOM} {RANDOM}",
                        "password=secret=abcdefgh"]
    got = secrets.masked(secrets.scan(documents(list(enumerate(rows))))).collect()
    for row in got:
        text, expected, at = rows[row.doc_id], "", 0
        for span in row.spans:
            if span.start >= at:
                expected += text[at:span.start] + ("" if span.start == at and at else "[SECRET]")
            at = max(at, span.end)
        assert row.text == (expected + text[at:] if row.spans else text)
        assert RANDOM not in (row.text or "")


def test_columns_and_empty_tables(spark, documents):
    docs = documents([(1, RANDOM), (1, RANDOM), (None, None)]).withColumn("spans", F.lit(1))
    assert [len(r.spans) for r in secrets.scan(docs).collect()] == [1, 1, 0]
    assert secrets.scan(docs.limit(0)).collect() == []


def test_whole_secrets_with_separators_and_letters_alone(spark, documents):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    alphabets = [letters + "0123456789-_", letters + "0123456789+/", letters]
    given = ["".join(rng.choices(alphabets[i % 3], k=(32, 40)[i % 2])) for i in range(1200)]
    rows = secrets.scan(documents([(i, f"see {v} here") for i, v in enumerate(given)])).collect()
    whole = [any((s.kind, s.start, s.end) == ("random", 4, 4 + len(given[r.doc_id])) for s in r.spans) for r in rows]
    assert sum(whole) >= 0.99 * len(given)
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    assert ("random", key) in kinds(spark, documents, f"aws_secret_access_key = {key}")
    assert ("random", key) in kinds(spark, documents, f"aws_secret_access_key={key}")
    assert [k for k, _ in kinds(spark, documents, f"sha256-{SHA256}/usr/share/dict/words-2024-01-02")] == ["hex"]
