"""Arrow-batched row functions: the one place where operators hand rows to Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


#: Rows that Python works on and hands back at a time. What a batch of ten thousand long texts gives would be held several
#: times over, in the worker and in the executor that reads it.
PIECE_ROWS = 500


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``PIECE_ROWS``, without a copy."""
    for batch in batches:
        for start in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(start, PIECE_ROWS)


def with_columns(df: DataFrame, source: str, added: T.StructType,
                     make: Callable[[], Callable[[pa.Array], list]]) -> DataFrame:
    """``df`` with ``added`` columns computed from ``source``, piece by piece, rows and order as they are.

    ``make`` runs once per task and returns a function from a piece's values to one list or Arrow array
    per added column. Columns of ``df`` that have a name of ``added`` are replaced.
    """
    names = set(added.fieldNames())
    kept = [c for c in df.columns if c not in names]
    # A source replaced by its own result travels along as one more column.
    carried = kept if source in kept else [*kept, source]
    at = carried.index(source)
    # By place: Arrow functions resolve names again, which dots in them would break.
    sent = df.select(*[df["`" + c.replace("`", "``") + "`"].alias(f"c{i}") for i, c in enumerate(carried)])
    schema = T.StructType([df.schema[c] for c in kept] + list(added.fields))
    types = [(f.name, to_arrow_type(f.dataType)) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in pieces(batches):
            made = compute(batch.column(at))
            columns = [v.cast(t) if isinstance(v, pa.Array) else pa.array(v, type=t)
                       for v, (_, t) in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(kept))] + columns, names=kept + [n for n, _ in types])

    return sent.mapInArrow(run, schema)


def apart(df: DataFrame, needed: list[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` on ``df`` with all columns but ``needed`` under names that no operator uses; its rows in the columns of ``df``."""
    names = {c: c if c in needed else f"__kept{i}__" for i, c in enumerate(df.columns)}
    done = run(df.select(*[df["`" + c.replace("`", "``") + "`"].alias(n) for c, n in names.items()]))
    return done.select(*[done[n].alias(c) for c, n in names.items()])
