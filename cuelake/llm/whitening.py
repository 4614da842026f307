"""Whitening of embeddings: projections on the leading components of their covariance, each of variance one.

Entries become whole numbers, so counts, sums and deviations are exact. Rows are centred before anything is multiplied;
Spark's row matrix takes the singular values of the centred rows, whose squares over n are the eigenvalues. The
total variance comes from the exact deviations, so a share needs no eigenvalue that was not asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Entries beyond this in size are an error, as their sums would not be exact.
LARGEST = 1 << 45
#: A component whose singular value is less than this share of the largest can't be told from rounding, and is left out.
LEAST = 1e-5
#: Rows that are worked on at once in a task.
ROWS = 2048


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows whose vector isn't null, empty, and has no null or non-finite entry."""
    ids = F.col("vec_id") if "vec_id" in vectors.columns else F.lit(None).cast("bigint")
    rows = vectors.select(ids.alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where("size(embedding) > 0").where(F.forall("embedding", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))))


def whole_numbers(column: pa.Array, size: int | None = None) -> np.ndarray:
    """A row of whole numbers per vector; all vectors are of one size."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(SCALE * c) + SHIFT
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"an entry is beyond {LARGEST / SCALE:.0f}: its sums would not be exact")
    return x.astype(np.int64).reshape(len(column), -1 if size is None else size)


@dataclass(frozen=True)
class Moments:
    """Count and exact sums per dimension."""

    n: int
    sums: tuple[int, ...]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        whole, rest = np.array([s // self.n for s in self.sums]), np.array([s % self.n for s in self.sums])
        d = x - whole
        if len(d) and float(np.abs(d).max()) * self.n > 2.0**62:
            raise OverflowError("a deviation doesn't fit 64 bits")
        return d * self.n - rest

    def squares(self, d: np.ndarray) -> np.ndarray:
        """Sums of the squared deviations per row; an error, not a wrong number, beyond 64 bits."""
        if len(d) and float((d.astype(np.float64) ** 2).sum(1).max()) > 2.0**62:
            raise OverflowError("a sum of squared deviations doesn't fit 64 bits")
        return (d * d).sum(1)


@dataclass(frozen=True)
class Whitening:
    moments: Moments
    #: Unit eigenvectors as columns, and their eigenvalues, falling.
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float = 0.0
    identity_error: float = 0.0

    def apply(self, d: np.ndarray) -> np.ndarray:
        return (d / self.moments.n) @ self.components / np.sqrt(self.eigenvalues)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def moments(rows: DataFrame) -> Moments:
    """Of the vectors of the commonest size (of several, the largest); sums leave a task as one row per batch and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            column = b.column("embedding")
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                own = column.filter(pa.array(sizes == size))
                s = whole_numbers(own).sum(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, size, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(s), pa.array(np.full(size, len(own), np.int64))], ["size", "i", "s", "n"])

    parts = rows.select("embedding").mapInArrow(run, "size int, i int, s bigint, n bigint")
    sums = written(parts.groupBy("size", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")), "sums")
    most = sums.where("i = 0").orderBy(F.desc("n"), F.desc("size")).head()
    if most is None:
        return Moments(0, ())
    found = sums.where(F.col("size") == most["size"]).orderBy("i").collect()  # a row per dimension
    return Moments(most["n"], tuple(int(r["s"]) for r in found))


def _centred(rows: DataFrame, m: Moments) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            x = m.deviations(whole_numbers(b.column("embedding"))) / m.n
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())], ["x"])

    return rows.select("embedding").mapInArrow(run, "x array<double>")


def _measured(rows: DataFrame, w: Whitening) -> Whitening:
    """w with the trace, from the exact deviations, and the largest entry of the whitened rows' covariance less the identity."""
    k, n = w.components.shape[1], w.moments.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            d = w.moments.deviations(whole_numbers(b.column("embedding")))
            y = w.apply(d)
            values = np.concatenate([(y.T @ y).ravel(), y.sum(0)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values), pa.array([Decimal(0)] * len(values), pa.decimal128(38))], ["i", "v", "d"])
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0.0]), pa.array([Decimal(int(w.moments.squares(d).astype(object).sum()))], pa.decimal128(38))], ["i", "v", "d"])

    parts = rows.select("embedding").mapInArrow(run, "i int, v double, d decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v"), F.sum("d").alias("d"))
    found = {r["i"]: r for r in parts.collect()}  # a row per entry of a k by k matrix
    trace = float(Fraction(int(found[-1]["d"]), n**3))
    square = np.array([found[i]["v"] for i in range(k * k)]).reshape(k, k) / n
    mean = np.array([found[k * k + i]["v"] for i in range(k)]) / n
    error = float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0
    return Whitening(w.moments, w.components, w.eigenvalues, trace, error)


def fit(rows: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """Components by the singular values of the centred rows (vec_id, embedding, as usable() returns them); None without rows."""
    m = moments(rows)
    if not m.n:
        return None
    d = len(m.sums)
    rows = rows.where(F.size("embedding") == d)
    vectors = MLUtils.convertVectorColumnsFromML(_centred(rows, m).select(array_to_vector("x").alias("x")), "x")
    values, vecs = np.zeros(0), np.zeros((d, 0))
    if m.n > 1:
        try:
            svd = RowMatrix(vectors, m.n, d).computeSVD(min(k, d), rCond=LEAST)
            values, vecs = svd.s.toArray(), svd.V.toArray()
        except Exception as e:
            if "zero" not in str(e).lower():  # no variance at all: there is no singular value to ask for
                raise
    found = values > 0
    values, vecs = values[found], vecs[:, found]
    if vecs.size:
        vecs = vecs * np.where(vecs[np.abs(vecs).argmax(0), np.arange(vecs.shape[1])] < 0, -1, 1)
    return _measured(rows, Whitening(m, vecs, values**2 / m.n))


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row per usable vector and component.

    Vectors that are null, empty, or hold a null or non-finite entry go, and so do those of another size than the
    commonest. Components without variance (LEAST) have no rows: equal vectors, or a single one, give an empty
    result, as an empty table does. Rows that repeat a vec_id, or have none, are rows of their own. Other columns are
    left out. A sum of squares beyond 64 bits is an error.
    """
    rows = usable(vectors)
    w = fit(rows, k)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if w is None:
        return rows.sparkSession.createDataFrame([], schema)
    share = w.eigenvalues / w.trace if w.trace else w.eigenvalues

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            d = w.moments.deviations(whole_numbers(b.column("embedding")))
            y = w.apply(d)
            r, c = y.shape
            ids = b.column("vec_id").take(pa.array(np.repeat(np.arange(r), c)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), r)), pa.array(np.full(r * c, w.moments.n, np.int64)), pa.array(np.repeat(w.moments.squares(d), c)),
                pa.array(y.ravel()), pa.array(np.tile(share, r)), pa.array(np.full(r * c, w.identity_error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("embedding") == len(w.moments.sums)).mapInArrow(run, schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
