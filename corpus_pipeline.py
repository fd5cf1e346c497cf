"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

1. ``quality``: documents that the quality rules reject go.
2. ``near_duplicates``: of each group of near or exact copies one document stays.
3. ``secrets``: what the scan finds is masked in the text, and ``n_chars`` counted anew; no document goes.
4. ``mixing``: documents stand as often as their rates ask for, so that toxic ones go, poor ones are thinned to
   their share, and good ones stay, some of them twice. Repeated rows are what a rate above 1 means.
5. ``bpe``: token ids and their number are added.

All stages but the last return the columns of ``documents``. An empty table passes through. No SQL dialect
expresses the stages, so ``ORACLE_SQL`` is None; tests/llm/test_queries.py holds them against plain versions, and
tests/llm/test_pipeline.py runs them on clashing columns, nulls, repeated rows and an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apptledger.llm import bpe, mixing, neardup, quality, secrets
from apptledger.llm.arrow import apart
from apptledger.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: What stages work on; all other columns travel under names that no operator uses.
NEEDED = ["doc_id", "text"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apart(docs, NEEDED, neardup.deduplicated)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = apart(docs, NEEDED, lambda rows: secrets.masked(secrets.scan(rows, spans="secret_spans"), spans="secret_spans"))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
