"""The registered queries over the smallest tables, against SQL or a plain version."""

from __future__ import annotations

import collections
import hashlib
from pathlib import Path

import duckdb
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from apptledger.llm import bpe, queries, secrets
from apptledger.llm.queries import QUERIES, SQL

from .test_neardup import brute_force
from .test_quality import words_of
from .test_secrets import base
from .test_topk import brute_force as all_products

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, len(QUERIES) + 1))


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(SQL[name])
    order = [d[0] for d in cursor.description]
    expected = collections.Counter(tuple(row[order.index(c)] for c in df.columns) for row in cursor.fetchall())
    assert collections.Counter(map(tuple, df.collect())) == expected and expected


def test_op1(spark, texts):
    tokenizer = Tokenizer.from_file(bpe.default_path())
    rows = queries.op1_bpe(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = tokenizer.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert (row.n_tokens, row.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert row.decoded_sha256 == sha(tokenizer.decode(ids, skip_special_tokens=False))


def test_op2(spark, texts):
    rows = queries.op2_compression(spark, SF_DIR).collect()
    assert {r.doc_id: r.n_words for r in rows} == {i: len(words_of(t)) for i, t in texts.items()}


def test_op4(spark, texts):
    rows = queries.op4_minmax_neardup(spark, SF_DIR).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == brute_force(sorted(texts.items()))


def test_op5(spark, texts, duck):
    rows = {r.doc_id: r for r in queries.op5_mixing(spark, SF_DIR).collect()}
    assert set(rows) == set(texts)
    assert all(abs(r.p_good + r.p_poor + r.p_toxic - 1) < 1e-9 and r.rate >= 0 for r in rows.values())


def test_op6(spark, duck):
    vectors = duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    rows = queries.op6_topk(spark, SF_DIR).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in rows) == all_products(vectors)


def test_op8(spark, duck):
    rows = queries.op8_main_text(spark, SF_DIR).collect()
    assert len(rows) == duck.execute("SELECT count(*) FROM pages").fetchall()[0][0]
    assert all(r.n_chars == len(r.text) for r in rows) and sum(r.n_chars > 100 for r in rows) > len(rows) / 2


def test_op9(spark, texts):
    for row in queries.op9_secrets(spark, SF_DIR).collect():
        spans = base(texts[row.doc_id])
        listed = [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans]
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        assert row.base_sha256 == sha(",".join(listed)) and set(listed) <= {*row.spans.split(",")} | set(listed) - {""}
        assert [s for s in row.spans.split(",") if s and not s.startswith("random")] == listed


def test_pipeline_step_by_step(spark, texts):
    """Each stage on what the one before kept, against the operators' plain versions."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR).cache()
        if name != "bpe":
            assert docs.columns == columns
        seen[name] = docs.collect()
    ids = {name: {r.doc_id for r in rows} for name, rows in seen.items()}
    kept = {r.doc_id for r in queries.op2_compression(spark, SF_DIR).collect() if r.kept}
    assert ids["quality"] == kept and len(seen["quality"]) == len(kept)
    stay = {i for i, (_, _, k) in brute_force(sorted((i, texts[i]) for i in kept)).items() if k}
    assert ids["near_duplicates"] == stay and len(seen["near_duplicates"]) == len(stay)
    assert ids["secrets"] == stay
    for row in seen["secrets"]:
        assert not base(row.text) or "[SECRET]" in row.text
        assert row.n_chars == len(row.text)
    assert ids["mixing"] <= stay
    tokenizer = Tokenizer.from_file(bpe.default_path())
    for row in seen["bpe"]:
        assert row.ids == tokenizer.encode(row.text, add_special_tokens=False).ids and row.n_tokens == len(row.ids)
    assert collections.Counter(r.doc_id for r in seen["bpe"]) == collections.Counter(r.doc_id for r in seen["mixing"])


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0
