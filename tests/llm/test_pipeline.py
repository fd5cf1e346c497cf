"""The pipeline as a whole, on tables that no real corpus looks like."""

from __future__ import annotations

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from apptledger.llm import neardup, quality

from .conftest import ODD_TEXTS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CLASHING = ["domain", "n_words", "kept", "rate", "p_good", "secret_spans", "class", "bands", "cell", "of", "count", "ids"]


@pytest.fixture(scope="module")
def prose(spark):
    """Texts that the first stages keep."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = neardup.deduplicated(quality.kept(docs)).where("length(text) < 3000").orderBy("doc_id").limit(40)
    return [r.text for r in found.collect()]


@pytest.fixture()
def folder(spark, tmp_path):
    def make(docs, labels=()):
        docs.write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path)

    return make


def run(spark, path):
    return corpus_pipeline.run(spark, path)


def test_clashing_columns_keep_their_values(spark, documents, folder, prose):
    docs = documents([(i, prose[i]) for i in range(30)])
    docs = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in CLASHING})
    path = folder(docs, [(i, 1, 0) for i in range(30)])
    before = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, before, path)
        assert rows.columns == docs.columns, name
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows.collect() for n in CLASHING), name
    out = run(spark, path)
    assert {r.doc_id for r in out.collect()} == set(range(30)) and all(r["rate"] == f"rate{r.doc_id}" and r.n_tokens == len(r.ids) for r in out.collect())


def test_nulls_repeats_and_odd_texts(spark, documents, folder, prose):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, prose[1]), (None, None), (50, prose[2]), (50, prose[2]), (50, prose[3]), (51, prose[3])]
    docs = documents(rows).withColumn("lang", F.when(F.col("doc_id") != 50, F.col("lang")))
    got = run(spark, folder(docs, [(50, 1, 0), (None, None, None)])).collect()
    counts = collections.Counter((r.doc_id, r.text) for r in got)
    assert counts[None, prose[1]] >= 1 and counts[50, prose[2]] >= 1
    assert (counts[50, prose[3]] > 0) != (counts[51, prose[3]] > 0), "one of two copies stays"


def test_an_empty_table(spark, documents, folder):
    out = run(spark, folder(documents([])))
    assert out.columns[:5] == COLUMNS and out.count() == 0
