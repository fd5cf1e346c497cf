"""Rows that Python holds at a time."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa
from pyspark.sql import types as T

from apptledger.llm import arrow, bpe


def test_batches_are_worked_on_in_pieces(spark):
    """A batch of Arrow's default size gives its results piece by piece, in order and whole."""
    def make():
        return lambda values: [[len(values)] * len(values), [None if v is None else v.upper() for v in values.to_pylist()]]

    rows = 2 * arrow.PIECE_ROWS + 7
    docs = spark.range(0, rows, 1, 1).selectExpr("id", "if(id % 5 = 0, null, concat('t', id)) as text")
    added = T.StructType([T.StructField("at_once", T.LongType()), T.StructField("upper", T.StringType())])
    got = arrow.with_columns(docs, "text", added, make).collect()
    assert max(r.at_once for r in got) == arrow.PIECE_ROWS
    assert [(r.id, r.upper) for r in got] == [(i, None if i % 5 == 0 else f"T{i}") for i in range(rows)]


def test_pieces_of_an_empty_batch_and_of_none():
    assert list(arrow.pieces(iter([]))) == []
    assert list(arrow.pieces(iter([pa.record_batch({"a": pa.array([], pa.int64())})]))) == []


def test_character_tables_take_little_memory():
    """A worker asks for them in parts; a string for each code point at once took 26 MB."""
    tracemalloc.start()
    try:
        bpe.Unicode()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 8e6 and len(bpe.POINTS) * bpe.POINTS.itemsize < 2e6
