"""Near-duplicate documents by min-max hashing, every link confirmed on whole shingle sets.

Text is lower-cased in A-Z and cut into words at ASCII white space. A document's set holds its distinct
shingles of ``SHINGLE`` words, as 64-bit hashes; with fewer words, the whole sequence as one; without
words nothing. Two documents are linked when ``100 * |A and B| >= 85 * |A or B|``. A document's component is
what links reach, named by the smallest id in it.

Min-max hashing keeps the least and the greatest value of a set under each permutation, so 84 permutations
give 168 values: 28 bands of 6. A pair at the threshold shares no band once in 600,000 cases. The steps:

1. One pass over the texts gives each its set's size, a 128-bit digest of the set, and its band keys. Equal
   sets are one class from here on, however many copies there are.
2. Classes that share a band form candidate clusters (components of the graph band-class).
3. Sets are made again for clustered classes only and compared within clusters. A large cluster is dealt
   into blocks by hash, and every two blocks meet in a group of their own, so no group holds more than about
   ``2 * BLOCK`` sets or ``2 * BLOCK_SHINGLES`` shingles, unless a single set is larger. In a group, pairs with a
   common band are compared by a product of membership matrices; the group returns a spanning forest of
   its links, never all pairs.
4. Components of the links, written back to classes and documents.

Defined results: null or wordless text has size 0 and links with nothing. Rows without an id keep their size, are linked with nothing, have no component and
are kept. Rows that repeat an id with another text are nodes of their own that share the id. Repeated rows share a
class. An empty table gives an empty one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apptledger.llm.arrow import pieces, with_columns
from apptledger.llm.components import components
from apptledger.operators.joins import BROADCAST_LIMIT_CONF, spread_join
from apptledger.session import materialized

SHINGLE = 5
PERCENT = 85
PERMUTATIONS, ROWS = 84, 6
BANDS = 2 * PERMUTATIONS // ROWS
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
#: Columns of a membership matrix that are multiplied at a time.
STRIP = 4096
#: Smaller sets are linked with equal ones only: 5 shingles of 6 are less than 85 percent.
LEAST_LINKED = 6
#: Bytes that a row of ids may take in a broadcast table, generously.
ROW_BYTES = 100

SKETCH = T.StructType([
    T.StructField("n_shingles", T.LongType()), T.StructField("class", T.BinaryType()),
    T.StructField("bands", T.ArrayType(T.LongType()))])

_random = np.random.default_rng(20240501)
FACTOR = _random.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
SHIFT = _random.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
STEP = np.uint64(0x9E3779B97F4A7C15)
NOTHING = np.zeros(0, np.uint64)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of ``size`` words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return NOTHING
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    count = len(words) - size + 1
    rolled = hashes[:count].copy()
    for k in range(1, size):
        rolled *= STEP
        rolled += hashes[k:k + count]
    return np.unique(rolled)


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """Least values under each permutation, then greatest ones."""
    high = (shingle_set >> np.uint64(32)).astype(np.uint32)
    least = np.full(PERMUTATIONS, 2**32 - 1, np.uint32)
    greatest = np.zeros(PERMUTATIONS, np.uint32)
    for start in range(0, len(high), STRIP):
        values = high[None, start:start + STRIP] * FACTOR[:, None] + SHIFT[:, None]
        np.minimum(least, values.min(axis=1), out=least)
        np.maximum(greatest, values.max(axis=1), out=greatest)
    return np.concatenate([least, greatest])


def band_keys(shingle_set: np.ndarray) -> list[int]:
    """One signed 64-bit key per band; none for sets too small to have an unequal partner."""
    if len(shingle_set) < LEAST_LINKED:
        return []
    rows = signature(shingle_set).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(row.tobytes(), seed=i) for i, row in enumerate(rows)],
                    np.uint64).view(np.int64).tolist()


def digest(shingle_set: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingle_set.tobytes())


def sketched(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``n_shingles``, ``class`` and ``bands``."""

    def make():
        def compute(texts: pa.Array) -> list[list]:
            sizes, classes, bands = [], [], []
            for value in texts:
                found = shingles(value.as_py())
                sizes.append(len(found))
                classes.append(digest(found) if len(found) else None)
                bands.append(band_keys(found))
            return [sizes, classes, bands]

        return compute

    return with_columns(df, text, SKETCH, make)


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets, by products of membership matrices, strip by strip."""
    all_left, all_right = np.concatenate(left), np.concatenate(right)
    # Only shingles on both sides count.
    columns = np.intersect1d(all_left, all_right)
    counts = np.zeros((len(left), len(right)), np.float32)
    if not len(columns):
        return counts

    def places(values: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(columns, values)
        at[at == len(columns)] = 0
        found = columns[at] == values
        order = np.argsort(at[found], kind="stable")
        return rows[found][order], at[found][order]

    (row_l, col_l), (row_r, col_r) = places(all_left, left), places(all_right, right)
    for start in range(0, len(columns), STRIP):
        width = min(STRIP, len(columns) - start)
        strips = []
        for rows, cols, sets in ((row_l, col_l, left), (row_r, col_r, right)):
            a, b = np.searchsorted(cols, [start, start + width])
            strip = np.zeros((len(sets), width), np.float32)
            strip[rows[a:b], cols[a:b] - start] = 1
            strips.append(strip)
        counts += strips[0] @ strips[1].T
    return counts


def linked(sets: list[np.ndarray], bands: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between places ``left`` and ``right`` that share a band."""
    sizes = np.array([len(s) for s in sets], np.int64)
    candidate = np.zeros((len(left), len(right)), bool)
    for k in range(bands.shape[1]):
        candidate |= bands[left, k][:, None] == bands[right, k][None, :]
    a, b = sizes[left][:, None], sizes[right][None, :]
    candidate &= 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)
    candidate &= left[:, None] != right[None, :]
    if not candidate.any():
        return
    rows, cols = np.flatnonzero(candidate.any(axis=1)), np.flatnonzero(candidate.any(axis=0))
    both = shared([sets[i] for i in left[rows]], [sets[i] for i in right[cols]])
    union = sizes[left[rows]][:, None] + sizes[right[cols]][None, :] - both
    close = candidate[np.ix_(rows, cols)] & (100 * both >= PERCENT * union)
    # Breadth first over rows and columns in turn; a place on both sides is one node.
    rows, cols = left[rows], right[cols]
    seen = np.zeros(len(sets), bool)
    for start in range(len(rows)):
        if seen[rows[start]]:
            continue
        seen[rows[start]] = True
        frontier = [rows[start]]
        while frontier:
            node = frontier.pop()
            near = np.concatenate([cols[close[rows == node].any(axis=0)], rows[close[:, cols == node].any(axis=1)]])
            for other in np.unique(near[~seen[near]]):
                seen[other] = True
                frontier.append(other)
                yield node, other


def compare(table: pa.Table) -> pa.Table:
    """Links of one group: of one block with itself, or of two blocks with each other."""
    sets = [np.frombuffer(v, np.uint64) for v in table.column("shingles").to_pylist()]
    bands = np.array(table.column("bands").to_pylist(), np.int64)
    classes = table.column("class").to_pylist()
    block = np.array(table.column("block").to_pylist())
    first, second = table.column("first")[0].as_py(), table.column("second")[0].as_py()
    pairs = list(linked(sets, bands, np.flatnonzero(block == first), np.flatnonzero(block == second)))
    return pa.table({"a": pa.array([classes[i] for i, _ in pairs], pa.binary()),
                     "b": pa.array([classes[j] for _, j in pairs], pa.binary())})


def checked_broadcast(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its counted rows are few enough; else left to a shuffled join."""
    limit = int(df.sparkSession.conf.get(BROADCAST_LIMIT_CONF, str(32 << 20)))
    return F.broadcast(df) if df.count() * ROW_BYTES <= limit else df


def links(docs: DataFrame, sketches: DataFrame, id_column: str, text: str) -> DataFrame:
    """(a, b) class digests, enough of them to connect every component of classes."""
    classes = sketches.where(f"size(bands) > 0 and `{id_column}` is not null").groupBy("class").agg(
        F.min(id_column).alias("member"), F.any_value("bands").alias("bands"), F.any_value("n_shingles").alias("n"))
    banded = classes.select("class", F.explode("bands").alias("band"))
    pivots = banded.groupBy("band").agg(F.min("class").alias("pivot"), F.max("class").alias("last")).where("pivot <> last")
    stars = banded.join(pivots, "band").where("class <> pivot").select(F.col("class").alias("a"), F.col("pivot").alias("b"))
    clusters = materialized(
        components(stars).join(classes.select("class", "member", "bands", "n"), F.col("node") == F.col("class"))
        .select("class", "member", "bands", "n", F.col("root").alias("cluster")), "clusters")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    large = materialized(clusters.groupBy("cluster").agg(blocks.alias("blocks")).where("blocks > 1"), "blocks")
    placed = clusters.join(checked_broadcast(large), "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    # Texts of one member per class, and of rows that share its id: made into sets again, one per class.
    members = checked_broadcast(clusters.select(F.col("member").alias(id_column)).distinct())
    texts = docs.join(members, id_column, "left_semi").select(F.col(f"`{text}`").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [shingles(v.as_py()) for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())],
                names=["class", "shingles"])

    made = texts.mapInArrow(sets, "class binary, shingles binary").dropDuplicates(["class"])
    dealt = placed.join(made, "class").withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = dealt.select(
        "cluster", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"),
        "block", "class", "bands", "shingles")
    return groups.groupBy("cluster", "first", "second").applyInArrow(compare, "a binary, b binary")


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: its id, ``n_shingles``, ``component_id`` and ``kept``."""
    return verdicts(df, id_column, text).drop("class", "root")


def verdicts(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """``near_duplicates`` with the ``class`` of each row and the ``root`` of its component, both null where a text has no
    words. Components that share their smallest id, as its rows hold several texts, differ in their roots."""
    docs = df.select(df[f"`{id_column}`"], df[f"`{text}`"])
    sketches = materialized(sketched(docs, text).drop(text), "sketches")
    found = materialized(links(docs, sketches, id_column, text), "near")
    roots = materialized(components(found), "roots")
    # Of each class its smallest id; of classes in a component the smallest of all.
    classes = materialized(sketches.where(f"class is not null and `{id_column}` is not null").groupBy("class").agg(
        F.min(id_column).alias("member"), F.count(F.lit(1)).alias("_rows")), "classes")
    named = classes.join(roots, classes["class"] == roots["node"]).select("class", "member", "root")
    names = named.groupBy("root").agg(F.min("member").alias("name"))
    renamed = materialized(named.join(names, "root").select("class", "name", "root"), "renamed")
    members = classes.join(renamed, "class", "left").select(
        "class", F.coalesce("name", "member").alias("component_id"), F.coalesce("root", "class").alias("root"))
    # A class of very many copies is spread by their ids.
    joined = spread_join(sketches.select(id_column, "n_shingles", "class"), members, ["class"], "left", spread_by=[id_column],
                         counts=classes.select("class", "_rows"))
    own = F.col(f"`{id_column}`")
    return joined.select(
        own, "n_shingles", "class", "root", F.when(own.isNotNull(), F.coalesce("component_id", own)).alias("component_id"),
    ).withColumn("kept", F.coalesce(own == F.col("component_id"), F.lit(True)))


def deduplicated(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: one document of each component, and one of rows that repeat id and text.

    Of rows that share an id each text is judged for itself, so a text without a copy stays whatever else bears its id."""
    verdict = materialized(verdicts(df, id_column, text), "verdicts")
    known = verdict.where(F.col(f"`{id_column}`").isNotNull())
    repeated = materialized(known.groupBy(id_column).count().where("count > 1").select(id_column), "repeated")
    dropped = materialized(known.where("not kept").select(id_column).distinct(), "dropped")
    if repeated.isEmpty():
        return df.join(checked_broadcast(dropped), id_column, "left_anti").select(*[df[f"`{c}`"] for c in df.columns])
    again = checked_broadcast(repeated)
    single = df.join(again, id_column, "left_anti").join(checked_broadcast(dropped), id_column, "left_anti")
    # Few ids repeat, if any, so texts are sketched once more for these only.
    columns = [f"__row{i}__" for i in range(len(df.columns))]
    rows = df.join(again, id_column, "left_semi").select(*[df[f"`{c}`"].alias(n) for c, n in zip(df.columns, columns, strict=True)])
    own, body = (columns[df.columns.index(c)] for c in (id_column, text))
    classed = sketched(rows, body).select(*columns, F.col("class").alias("__class__"))
    judged = known.join(again, id_column, "left_semi").select(
        F.col(f"`{id_column}`").alias("__id__"), F.col("class").alias("__of__"), F.col("root").alias("__root__"), "kept").distinct()
    met = classed.join(judged, (F.col(own) == F.col("__id__")) & F.col("__class__").eqNullSafe(F.col("__of__"))).where("kept")
    # Without words nothing is a near copy, so only the same text is a repetition.
    met = met.withColumn("__same__", F.when(F.col("__class__").isNull(), F.coalesce(F.col(body), F.lit("")))).dropDuplicates(
        [own, "__root__", "__same__"])
    return single.select(*[df[f"`{c}`"] for c in df.columns]).unionByName(
        met.select(*[F.col(n).alias(c) for c, n in zip(df.columns, columns, strict=True)]))
