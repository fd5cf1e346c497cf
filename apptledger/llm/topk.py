"""Exact top-k search by inner product over norm buckets.

Vectors become whole numbers, ``floor(scale * x)``, so products are exact. Candidates are ordered by length
and cut into buckets of about ``BUCKET`` rows. For a query with a known lower bound for its k-th score, a
bucket matters only if its longest vector can reach the bound: ``|q| * longest >= bound`` (whole buckets are
skipped, and within one the shorter rows). Which buckets those are is read off at most ``LEVELS`` steps of
length, however many buckets there are. What is left of the bound is a cosine that a bucket's vectors must
reach, its local threshold. Where that cosine is high, the query's largest coordinate
limits the same coordinate of any candidate to a short range, found by bisection in a sorted list; where it
is low, rows are pruned by length only. Products of the rows that remain are computed in full and
decide; pruning never does.

The bound comes from products with the ``BUCKET`` longest candidates, one bucket by construction. Queries
are packed into blocks of ``BLOCK`` rows and sent to the buckets that their bounds leave open; each
meeting returns at most k rows per query.

Vectors that are null, empty or hold null or non-finite components take no part, nor do those without an id. Vectors of different
lengths are never compared. A query is not its own candidate: rows with its id are left out. Repeated
rows are one vector; rows that share an id and differ are candidates of their own, and of such
queries each is answered with the best of all. Ties go to the smaller id. With fewer candidates than k, all
are returned. An empty table gives an empty one. Scores beyond 64 bits end at the greatest or least 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apptledger.session import materialized

BUCKET, BLOCK = 4096, 512
LEVELS = 1024
#: Local cosine thresholds from here on prune by coordinate, lower ones by length.
COORDINATE_FROM = 0.5
#: Pruning bounds are floating-point numbers; they are widened by this share.
SLACK = 1e-9
EXACT = 2**53
LEAST, GREATEST = 1 - 2**63, 2**63 - 1
LARGEST = 1.7976931348623157e308

PACKED = "bucket long, dim int, longest double, ids binary, vectors binary"


def whole_numbers(vector: Column, scale: float) -> Column:
    """``floor(scale * x)`` of each component as a double; null where the vector takes no part."""
    usable = F.forall(vector, lambda x: F.coalesce(x.cast("double"), F.lit(float("nan"))).between(-LARGEST, LARGEST))

    def whole(x: Column) -> Column:
        y = F.least(F.greatest(scale * x.cast("double"), F.lit(-LARGEST)), F.lit(LARGEST))
        return F.when(F.abs(y) < 2.0**62, F.floor(y).cast("double")).otherwise(y)

    return F.when((F.size(vector) > 0) & usable, F.transform(vector, whole))


def matrix(batch_vectors: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch_vectors), np.float64).reshape(-1, dim)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact products as objects or 64-bit integers."""
    bound = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * queries.shape[1]
    if bound < EXACT:
        return (queries @ rows.T).astype(np.int64)
    exact = np.array([[int(x) for x in q] for q in queries], object) @ np.array([[int(x) for x in r] for r in rows], object).T
    return np.clip(exact, LEAST, GREATEST).astype(np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids, the same id counted once."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    first.sort()
    return ids[first[:k]], scores[first[:k]]


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, dim, id, length, vector) that come sorted by bucket, as one row per bucket and dim."""
    schema = pa.schema([("bucket", pa.int64()), ("dim", pa.int32()), ("longest", pa.float64()),
                        ("ids", pa.binary()), ("vectors", pa.binary())])
    key, ids, vectors, longest = None, [], [], 0.0

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{
            "bucket": key[0], "dim": key[1], "longest": longest, "ids": np.array(ids, np.int64).tobytes(),
            "vectors": np.array(vectors, np.float64).tobytes()}], schema=schema)

    for batch in batches:
        for bucket, dim, number, length, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key is not None and (key != (bucket, dim) or len(ids) >= BUCKET):
                yield packed()
                ids, vectors, longest = [], [], 0.0
            key = (bucket, dim)
            ids.append(number)
            vectors.append(vector)
            longest = max(longest, length)
    if ids:
        yield packed()


class Bucket:
    """One bucket's rows by falling length, with each coordinate's order once it is asked for."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        lengths = np.sqrt((rows * rows).sum(axis=1))
        order = np.argsort(-lengths, kind="stable")
        self.ids, self.rows, self.lengths = ids[order], rows[order], lengths[order]
        self.by_coordinate: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def reachable(self, norm: float, bound: float) -> int:
        """How many rows, from the longest, are long enough."""
        if bound <= 0 or not np.isfinite(norm * self.lengths[0]):
            return len(self.rows)
        return int((self.lengths * norm * (1 + SLACK) >= bound).sum())

    def near(self, query: np.ndarray, norm: float, bound: float) -> np.ndarray | None:
        """Places whose coordinate lets them reach the bound; None where the local threshold is too low to tell."""
        most = norm * self.lengths[0]
        if bound <= 0 or not np.isfinite(most) or bound < COORDINATE_FROM * most:
            return None
        # A candidate within arccos(threshold) of the query has its coordinate's angle in this range.
        focus, width = int(np.abs(query).argmax()), np.arccos(min(1.0, bound / most * (1 - SLACK))) + 1e-7
        middle = np.arccos(np.clip(query[focus] / norm, -1, 1))
        low, high = np.cos(min(np.pi, middle + width)) - 1e-7, np.cos(max(0.0, middle - width)) + 1e-7
        if focus not in self.by_coordinate:
            values = self.rows[:, focus] / np.maximum(self.lengths, 1e-300)
            order = np.argsort(values, kind="stable")
            self.by_coordinate[focus] = order, values[order]
        order, values = self.by_coordinate[focus]
        return order[np.searchsorted(values, low):np.searchsorted(values, high, "right")]


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, id_column: str = "vec_id", vector: str = "embedding",
           scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of ``vectors`` for each row of ``queries``."""

    def prepared(df: DataFrame) -> DataFrame:
        numbers = df.select(F.col(f"`{id_column}`").cast("long").alias("id"), whole_numbers(F.col(f"`{vector}`"), scale).alias("v"))
        numbers = numbers.where("id is not null and v is not null").distinct()
        return numbers.select("id", F.size("v").alias("dim"), F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("length"), "v")

    rows = materialized(prepared(vectors), "vectors")
    total = rows.count()
    buckets = max(1, -(-total // BUCKET))
    # By falling length; ids part rows of one length, so that no bucket outgrows the others.
    ranged = rows.repartitionByRange(buckets, F.col("dim"), F.col("length").desc(), F.xxhash64("id"))
    sorted_rows = ranged.withColumn("bucket", F.spark_partition_id().cast("long")).sortWithinPartitions(
        "dim", F.col("length").desc(), "id")
    packed = materialized(sorted_rows.select("bucket", "dim", "id", "length", "v").mapInArrow(pack, PACKED), "buckets")
    asked = prepared(queries)
    block_count = max(1, -(-asked.count() // BLOCK))
    block_rows = (asked.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(block_count))).repartition(block_count, "bucket")
                  .sortWithinPartitions("bucket", "dim", "id").select("bucket", "dim", "id", "length", "v"))
    blocks = materialized(block_rows.mapInArrow(pack, PACKED), "queries")

    # The bucket with the longest vectors of each dimension: one row of at most BUCKET vectors each.
    first = packed.groupBy("dim").agg(F.max_by(F.struct("ids", "vectors"), F.struct("longest", "bucket")).alias("first"))
    bounded = materialized(
        blocks.join(first, "dim").select("dim", "ids", "vectors", F.col("first.ids").alias("c_ids"), F.col("first.vectors").alias("c_vectors"))
        .mapInArrow(lambda batches: bounds(batches, k), "bucket long, dim int, id long, bound double, length double, v array<double>"), "bounds")
    # Each query goes to the buckets that its bound leaves open.
    level = F.floor(F.col("bucket") * LEVELS / F.lit(buckets))
    levels = packed.groupBy("dim", level.alias("level")).agg(
        F.max("longest").alias("longest"), F.min("bucket").alias("first"), F.max("bucket").alias("last"))
    opened = levels.groupBy("dim").agg(F.collect_list(F.struct("longest", "first", "last")).alias("open"))
    reach = F.filter("open", lambda b: (F.col("bound") <= 0) | (b["longest"] * F.col("length") * (1 + SLACK) >= F.col("bound")))
    to = F.flatten(F.transform(reach, lambda b: F.sequence(b["first"], b["last"])))
    sent = bounded.join(opened, "dim").select("dim", "id", "bound", "length", "v", F.explode(to).alias("to"))
    part = F.pmod(F.xxhash64("id"), F.lit(block_count)).alias("part")
    dealt = sent.groupBy("to", "dim", part).agg(F.collect_list(F.struct("id", "bound", "length", "v")).alias("asked"))
    met = dealt.join(packed.withColumnRenamed("bucket", "to"), ["to", "dim"]).select("dim", "asked", "ids", "vectors")
    scored = met.mapInArrow(lambda batches: verified(batches, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def bounds(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A lower bound of each query's k-th score, from one bucket; minus infinity if it holds fewer than k others."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, c_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["c_ids"], np.int64)
            queries, rows = matrix([row["vectors"]], row["dim"]), matrix([row["c_vectors"]], row["dim"])
            scores = products(queries, rows)
            found = []
            for i, number in enumerate(ids):
                _, top = best(c_ids[c_ids != number], scores[i][c_ids != number], k)
                found.append(float(top[-1]) if len(top) == k else -np.inf)
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([0] * len(ids), pa.int64()), "dim": pa.array([row["dim"]] * len(ids), pa.int32()),
                "id": pa.array(ids), "bound": pa.array(found, pa.float64()),
                "length": pa.array(np.sqrt((queries * queries).sum(axis=1))),
                "v": pa.array(list(queries), pa.list_(pa.float64()))})


def verified(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of a bucket for each query of a block."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            bucket = Bucket(np.frombuffer(row["ids"], np.int64), matrix([row["vectors"]], row["dim"]))
            asked = row["asked"]
            queries = np.array([q["v"] for q in asked])
            counts = [bucket.reachable(q["length"], q["bound"]) for q in asked]
            near = [bucket.near(v, q["length"], q["bound"]) if n else None
                    for v, q, n in zip(queries, asked, counts, strict=True)]
            # Those pruned by length only are multiplied together.
            together = [i for i, n in enumerate(counts) if n and near[i] is None]
            if together:
                most = max(counts[i] for i in together)
                scores_of = dict(zip(together, products(queries[together], bucket.rows[:most]), strict=True))
            out: list[list] = [[], [], []]
            for i, query in enumerate(asked):
                if not counts[i]:
                    continue
                if near[i] is None:
                    ids, scores = bucket.ids[:counts[i]], scores_of[i][:counts[i]]
                else:
                    places = near[i][near[i] < counts[i]]
                    ids, scores = bucket.ids[places], products(queries[i:i + 1], bucket.rows[places])[0]
                bound = query["bound"]
                usable = ids != query["id"]
                if np.isfinite(bound):
                    usable &= scores >= bound - abs(bound) * SLACK
                top, score = best(ids[usable], scores[usable], k)
                out[0] += [query["id"]] * len(top)
                out[1] += top.tolist()
                out[2] += score.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])
