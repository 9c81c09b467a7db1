"""Operator 13: whitening of vectors by Chebyshev-filtered subspace iteration.

Entries become whole numbers x = floor(64 c) + 1000000 and are stored once, in blocks,
in the shared folder.  A pass over the blocks gives V Q for a thin matrix Q, where V is
the covariance: every task subtracts the means, multiplies X'(X Q) for its blocks and
sends one small matrix, and the matrices are added in groups.  V itself is never formed.

Between two Rayleigh-Ritz steps a Chebyshev polynomial of V, applied by its three-term
recurrence with one pass for each degree, damps the part of the spectrum below the
smallest Ritz value of the subspace.  QR makes the columns orthonormal, a pass and a
small eigenproblem give Ritz pairs, and the residual of each wanted pair certifies it.
A subspace that is not certified in time grows; at the full size it holds the
eigenvectors exactly.

The driver holds matrices of (length of a vector) x (size of the subspace) only.

Defined results: rows whose vector is NULL, empty, or holds a NULL or non-finite entry or
one beyond 2^46 take no part and give no rows; nor do vectors of another length than the
commonest (of equal counts the longer).  Repeated rows and ids count each; a NULL id
gives rows with it.  A component without variance (an eigenvalue of no more than 1e-12
times the largest) cannot be whitened and gives no rows, so one row, or equal rows, give
none.  A deviation beyond a long is NULL.  Other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import ready, release
from veritab.session import scratch_folder

STEP, SHIFT = 64, 1_000_000
LARGEST = float(1 << 46)
#: Rows of a stored block hold about this many bytes of entries.
BLOCK_BYTES = 1 << 20
#: Matrices that the driver adds without a step between.
GROUP = 64
#: Columns of the subspace beyond the wanted ones, degree of the filter, rounds before the subspace grows.
SPARE, DEGREE, ROUNDS = 16, 10, 6
#: A Ritz pair is certified when its residual is at most this share of the largest eigenvalue.
CERTIFIED = 1e-13


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    rows = batch.column(0).to_pylist()
    return np.concatenate([np.frombuffer(data, np.int64).reshape(n, -1) for data, n in zip(rows, batch.column(1).to_pylist(), strict=True)])


def numbers(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): the rows that take part, as whole numbers; the commonest length decides."""
    usable = (F.size(vector_col) > 0) & F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) <= LARGEST))
    rows = table.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    length = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()  # one row
    if length is None:
        length = (1,)
    x = F.transform("vector", lambda c: F.floor(c.cast("double") * STEP).cast("long") + SHIFT)
    return rows.where(F.size("vector") == length[0]).select("id", x.alias("x"))


def store(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the rows as blocks (ids, data, n) and reads them back."""
    ready(rows.sparkSession)
    kind = rows.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            most = max(1, BLOCK_BYTES // (8 * x.shape[1]))
            for a in range(0, len(x), most):
                part = x[a : a + most]
                ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), batch.column(0).slice(a, len(part)))
                yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()]), pa.array([len(part)], pa.int64()), ids], names=["data", "n", "ids"])

    rows.select("id", "x").mapInArrow(pack, f"data binary, n long, ids array<{kind}>").write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def summed(blocks: DataFrame, work: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of the matrices that `work` makes of all blocks.

    A task sends one matrix; those of many tasks are added in groups before they reach
    the driver, so that it gets no more than `GROUP` of them or the root of their number.
    """

    def adding(make: Callable[[pa.RecordBatch], np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            total = np.zeros(shape)
            for batch in batches:
                if batch.num_rows:
                    total += make(batch)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sum"])

        return run

    def added(batch: pa.RecordBatch) -> np.ndarray:
        return sum(np.frombuffer(data).reshape(shape) for data in batch.column(0).to_pylist())

    thin = blocks.select("data", "n")
    tasks = thin.rdd.getNumPartitions()
    parts = thin.mapInArrow(adding(lambda batch: work(_matrix(batch))), "sum binary")
    if tasks > GROUP:
        parts = parts.repartition(math.isqrt(tasks)).mapInArrow(adding(added), "sum binary")
    return sum((np.frombuffer(row.sum).reshape(shape) for row in parts.collect()), np.zeros(shape))


@dataclass
class Components:
    """Unit eigenvectors as columns by falling eigenvalue, and what whitening needs."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int

    @property
    def means(self) -> np.ndarray:
        return _means(self.sums, self.n)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.means) @ self.vectors) / np.sqrt(self.values)


def _means(sums: np.ndarray, n: int) -> np.ndarray:
    return np.array([int(s) / n for s in sums])


def moments(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Count and exact sums of all rows."""
    size = rows.select(F.size("x").alias("d")).first()
    if size is None:
        return 0, np.zeros(0, object)
    found = rows.agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("x")[j].cast("decimal(28,0)")) for j in range(size.d)]).alias("s")).first()
    return found.n, np.array([int(s) for s in found.s], object)


class _Covariance:
    """Products with the covariance of the stored blocks, counted."""

    def __init__(self, blocks: DataFrame, n: int, sums: np.ndarray):
        self.blocks, self.n, self.means, self.passes = blocks, n, _means(sums, n), 0

    def __call__(self, q: np.ndarray) -> np.ndarray:
        means, n = self.means, self.n
        self.passes += 1

        def work(x: np.ndarray) -> np.ndarray:
            centred = x - means
            return centred.T @ (centred @ q) / n

        return summed(self.blocks, work, q.shape)

    def trace(self) -> float:
        means, n = self.means, self.n
        return float(summed(self.blocks, lambda x: np.array([[((x - means) ** 2).sum() / n]]), (1, 1))[0, 0])


def damped(multiply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, upper: float, top: float, degree: int) -> np.ndarray:
    """T(V) q for the Chebyshev polynomial that is small on [0, upper], scaled to be one at `top`."""
    centre = half = upper / 2
    sigma = first = half / (top - centre)
    before, now = q, (multiply(q) - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, (multiply(now) - centre * now) * (2 * following / half) - before * (sigma * following)
        sigma = following
    return now


def components(blocks: DataFrame, n: int, sums: np.ndarray, wanted: int = 32, spare: int = SPARE, degree: int = DEGREE, certified: float = CERTIFIED) -> Components:
    """The eigenvectors of the largest eigenvalues of the covariance of all stored rows."""
    multiply, size = _Covariance(blocks, n, sums), len(sums)
    trace, draw = multiply.trace(), np.random.default_rng(13)
    wanted = min(wanted, size)
    width = min(size, wanted + spare)
    q = np.linalg.qr(draw.normal(size=(size, width)))[0]
    best, rounds = np.inf, 0
    while True:
        product = multiply(q)
        values, turn = np.linalg.eigh((small := q.T @ product) / 2 + small.T / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, product = q @ turn, product @ turn
        residual = float(np.linalg.norm(product[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max(initial=0.0))
        top = max(float(values[0]), 0.0) if width else 0.0
        rounds += 1
        if residual <= certified * top or width == size and rounds > 1 or not top:
            break
        if rounds >= ROUNDS and residual > best / 10:  # a flat spectrum: more columns widen the gap
            grown = min(size, 2 * width)
            q, width, rounds = np.concatenate([q, draw.normal(size=(size, grown - width))], axis=1), grown, 0
        best = residual
        upper = float(values[-1])
        if width < size and rounds and upper > 0 and upper < top:
            q = damped(multiply, q, upper, top, degree)
        q = np.linalg.qr(np.linalg.qr(q)[0])[0]
    kept = values[:wanted] > 1e-12 * top if top else np.zeros(wanted, bool)
    return Components(n, sums, q[:, :wanted][:, kept], values[:wanted][kept], trace, multiply.passes)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    reach = [max(abs(n * int(low) - s), abs(n * int(high) - s)) for low, high, s in zip(x.min(axis=0), x.max(axis=0), sums, strict=True)]
    if sum(r * r for r in reach) < 1 << 63 and n * int(np.abs(x).max()) < 1 << 63 and max(abs(s) for s in sums) < 1 << 63:
        return ((n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
    apart = n * x.astype(object) - sums
    return [int(v) if v < 1 << 63 else None for v in (apart**2).sum(axis=1)]


def whiten(table: DataFrame, wanted: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every remaining row and component."""
    spark = table.sparkSession
    rows = numbers(table, id_col, vector_col)
    kind = table.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, sums = moments(rows)
    if n == 0:
        return spark.createDataFrame([], schema)
    blocks = store(rows, scratch_folder(spark, "whitening"))
    model = components(blocks, n, sums, wanted)
    size = len(model.values)
    if not size:
        return spark.createDataFrame([], schema)
    products = summed(blocks, lambda x: (lambda w: np.concatenate([w.T @ w, w.sum(axis=0)[None]]))(model.whiten(x)), (size + 1, size)) / n
    covariance = products[:-1] - np.outer(products[-1], products[-1])
    error = float(np.abs(covariance - np.eye(size)).max())
    explained = model.values / model.trace

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                x, ids = _matrix(part), part.column(2).flatten()
                count = len(x)
                index = np.repeat(np.arange(count), size)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(index)), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), count)), pa.array(np.full(count * size, n)),
                        pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(index)), pa.array(model.whiten(x).reshape(-1)),
                        pa.array(np.tile(explained, count)), pa.array(np.full(count * size, error)),
                    ],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return blocks.mapInArrow(work, schema)
