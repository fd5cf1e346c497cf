"""Whitening of embeddings along their leading principal components, by Chebyshev-filtered subspace iteration.

Entries become whole numbers, ``floor(256 * c)``; the fit list holds each distinct vector once, so copies do not
weigh. A block of ``components + GUARD`` directions is iterated against the covariance, which is never formed: every
pass is one Spark job over the fit list that adds up ``Xc' (Xc Q)`` with ``Xc`` centred, task by task. Between the
passes the driver holds matrices of dimension by block only.

1. Start with random orthonormal directions; Rayleigh-Ritz gives first values.
2. The recurrence of Chebyshev polynomials damps the spectrum from 0 to the block's least Ritz value and lets
   what lies above grow. The degree is cut where the growth would outrun double precision.
3. QR and Rayleigh-Ritz on the filtered block. The wanted directions are certified once the residual norm
   ``|V q - e q|`` of each is below ``TOLERANCE`` times the greatest value; till then back to 2.
4. A block that stops gaining is widened; with as many directions as dimensions Rayleigh-Ritz is exact, so it ends.

Defined results: rows whose vector is null, or holds null or non-finite entries, are left out, as are vectors of
another length than most distinct vectors have (ties: the greater length). Entries beyond a long are held to its
ends. Directions without variance, within rounding, are no components: equal vectors, one vector or an empty table
give none. Where eigenvalues are equal, any orthonormal directions of their space may come out, the same for all rows.
``deviation`` is exact, and null where it exceeds a long. Columns named like the added ones are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apptledger.llm.arrow import with_columns
from apptledger.session import materialized

COMPONENTS = 4
SCALE = 256
#: Directions that are iterated beyond those asked for.
GUARD = 12
#: Greatest degree of the filter, and how far it may raise the greatest value over the damped ones.
DEGREE, GROWTH = 16, 1e8
TOLERANCE = 1e-13
#: Rounds without a tenfold gain after which the block is widened.
PATIENCE = 3
#: Eigenvalues below this share of the greatest are rounding.
NOTHING = 1e-13
#: Bytes of partial sums that the driver takes at once; beyond that they are first added up in groups.
PARTIALS = 32 << 20
LONG = np.iinfo(np.int64)
ADDED = T.StructType([T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.LongType())])


@dataclass(frozen=True)
class Whitening:
    """What a fit knows: ``directions`` has one column per component, by falling eigenvalue."""

    n: int
    sums: list[int]
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    residuals: np.ndarray
    passes: int

    @property
    def explained(self) -> list[float]:
        return [float(e) / self.trace for e in self.eigenvalues]


def usable(vector: str) -> Column:
    """The vector is there and all of its entries are finite."""
    column = F.col(f"`{vector}`")
    finite = F.forall(column, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(c.cast("double")))
    return column.isNotNull() & F.coalesce(finite, F.lit(False))


def whole(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        scaled = np.floor(values.astype(np.float64) * SCALE)
    held = np.clip(scaled, -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)
    return np.where(scaled >= 2.0**63, LONG.max, held)


def packed(vector: np.ndarray) -> bytes:
    """Equal vectors give equal bytes: the least width that holds all entries, then the entries."""
    low, high = (int(vector.min()), int(vector.max())) if len(vector) else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if -(1 << (8 * w - 1)) <= low and high < 1 << (8 * w - 1))
    return bytes([width]) + vector.astype(f"<i{width}").tobytes()


def vectors(batch: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, whole-number matrix) of an Arrow list column, one per length of vector."""
    lengths = batch.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    flat = batch.flatten().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield at, whole(flat[starts[at][:, None] + np.arange(length)[None, :]])


def unpacked(batch: pa.Array) -> np.ndarray:
    """A matrix again, of vectors of one length."""
    found = batch.to_pylist()
    by_width: dict[int, list[bytes]] = {}
    for value in found:
        by_width.setdefault(value[0], []).append(value[1:])
    return np.concatenate([
        np.frombuffer(b"".join(rows), f"<i{width}").reshape(len(rows), -1).astype(np.int64) for width, rows in by_width.items()])


def fit_list(df: DataFrame, vector: str) -> DataFrame:
    """The distinct vectors, packed, with their length; written to the shared folder."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {packed(row) for _, rows in vectors(batch.column(0)) for row in rows}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.binary())], names=["x"])

    chosen = df.where(usable(vector)).select(df[f"`{vector}`"])
    distinct = chosen.mapInArrow(pack, "x binary").distinct()
    length = (F.length("x") - 1) / F.ascii(F.substring("x", 1, 1).cast("string"))
    return materialized(distinct.select("x", length.cast("int").alias("length")), "fit-list")


def summed(fit: DataFrame, size: int, compute: Callable[[np.ndarray], np.ndarray], dtype: str = "<f8") -> np.ndarray:
    """``compute`` of every batch's matrix, an array of ``size`` numbers, added up over all tasks in their order."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = compute(unpacked(batch.column(0)))
                total = found if total is None else total + found
        if total is not None:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([total.astype(dtype).tobytes()], pa.binary())],
                                             names=["task", "total"])

    def add(table: pa.Table) -> pa.Table:
        rows = table.sort_by("task")
        total = sum(np.frombuffer(v, dtype) for v in rows.column("total").to_pylist())
        return pa.table({"task": rows.column("task").slice(0, 1), "total": pa.array([total.tobytes()], pa.binary())})

    partials = fit.select("x").mapInArrow(partial, "task long, total binary")
    tasks = fit.rdd.getNumPartitions()
    if tasks * size * 8 > PARTIALS:
        groups = math.isqrt(tasks) + 1
        partials = partials.groupBy(F.pmod("task", F.lit(groups))).applyInArrow(add, "task long, total binary")
    found = sorted((r.task, bytes(r.total)) for r in partials.collect())
    return sum((np.frombuffer(v, dtype) for _, v in found), np.zeros(size, dtype))


def sums_of(x: np.ndarray) -> np.ndarray:
    """Rows, and sums by dimension in two halves, so that none leaves a long."""
    return np.concatenate([[len(x)], (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])


def ritz(basis: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values by falling size, with the basis and its product turned to them."""
    small = basis.T @ product
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], basis @ turn[:, ::-1], product @ turn[:, ::-1]


def filtered(times: Callable[[np.ndarray], np.ndarray], basis: np.ndarray, product: np.ndarray, top: float, cut: float) -> np.ndarray:
    """A Chebyshev polynomial of the covariance applied to the block, small on 0 to ``cut``, 1 about ``top``."""
    half = max(cut, NOTHING * top) / 2
    degree = max(1, min(DEGREE, int(math.log(2 * GROWTH) / math.acosh(max(top / half - 1, 1 + 1e-12)))))
    first = sigma = half / (top - half)
    before, now = basis, (product - half * basis) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, (times(now) - half * now) * (2 * following / half) - (sigma * following) * before
        sigma = following
    return now


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The leading ``components`` of the distinct vectors of ``df``."""
    found = fit_list(df, vector)
    most = found.groupBy("length").count().orderBy(F.desc("count"), F.desc("length")).first()
    if most is None or not most["length"]:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, np.zeros(0), 0)
    d = most["length"]
    rows = found.where(F.col("length") == d)
    counted = summed(rows, 1 + 2 * d, sums_of, "<i8")
    n = int(counted[0])
    sums = [(int(high) << 32) + int(low) for high, low in zip(counted[1:d + 1], counted[d + 1:], strict=True)]
    mean = np.array([s / n for s in sums])
    passes = 0

    def covariance_times(block: np.ndarray) -> tuple[np.ndarray, float]:
        nonlocal passes
        passes += 1

        def compute(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return np.concatenate([(centred.T @ (centred @ block)).ravel(), [np.einsum("ij,ij->", centred, centred)]])

        total = summed(rows, block.size + 1, compute) / n
        return total[:-1].reshape(d, -1), float(total[-1])

    def times(block: np.ndarray) -> np.ndarray:
        return covariance_times(block)[0]

    random = np.random.default_rng(20240611)
    wanted, width = min(components, d), min(d, components + GUARD)
    basis = np.linalg.qr(random.standard_normal((d, width)))[0]
    product, trace = covariance_times(basis)
    history: list[float] = []
    while True:
        values, basis, product = ritz(basis, product)
        residuals = np.linalg.norm(product - basis * values, axis=0)[:wanted]
        if width == d or residuals.max() <= TOLERANCE * max(values[0], 0.0):
            break
        history.append(float(residuals.max()))
        block = filtered(times, basis, product, float(values[0]), float(max(values[-1], 0.0)))
        if len(history) > PATIENCE and history[-1] > history[-1 - PATIENCE] / 10:
            history.clear()
            width = min(d, 2 * width)
            block = np.concatenate([block, random.standard_normal((d, width - block.shape[1]))], axis=1)
        block = block / np.maximum(np.linalg.norm(block, axis=0), np.finfo(float).tiny)
        basis = np.linalg.qr(block)[0]
        product = times(basis)
    real = int((values[:wanted] > NOTHING * max(values[0], 0.0)).sum()) if trace > 0 else 0
    directions, eigenvalues = basis[:, :real], values[:real]
    error = 0.0
    if real:
        scaled = directions / np.sqrt(eigenvalues)

        def moments(x: np.ndarray) -> np.ndarray:
            z = (x - mean) @ scaled
            return np.concatenate([(z.T @ z).ravel(), z.sum(axis=0)])

        total = summed(rows, real * (real + 1), moments) / n
        off = total[:real * real].reshape(real, real) - np.outer(total[real * real:], total[real * real:])
        error = float(np.abs(off - np.eye(real)).max())
    return Whitening(n, sums, directions, eigenvalues, trace, error, residuals, passes)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of ``(n x - S)^2``, exact."""
    reach = n * int(max(abs(int(x.min())), abs(int(x.max())))) + max(map(abs, sums))
    if reach * reach * len(sums) <= LONG.max:
        apart = n * x - np.array(sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v <= LONG.max else None for v in exact]


def whitened(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """The rows of ``df`` that take part, with ``whitened`` (one number per component) and ``deviation``."""
    d = len(model.sums)
    # usable() first: CASE keeps the size test from null vectors.
    rows = df.where(F.when(usable(vector), F.size(F.col(f"`{vector}`")) == d).otherwise(False))
    rows = rows.where(F.lit(d > 0))

    def make():
        mean = np.array([s / model.n for s in model.sums])
        scaled = model.directions / np.sqrt(model.eigenvalues)

        def compute(batch: pa.Array) -> list[list]:
            if not len(batch):
                return [[], []]
            (_, x), = vectors(batch)
            return [((x - mean) @ scaled).tolist(), deviations(x, model.n, model.sums)]

        return compute

    return with_columns(rows, vector, ADDED, make)
