"""Whitening of embeddings by a covariance of two passes (operator 11).

Entries are quantised to integers, so the first pass sums them exactly. The second centres every row
on the exact mean and adds outer products batch by batch as one matrix product; each task gives one
matrix, and a tree of merges leaves one. Its eigenvectors (LAPACK) project the rows, which stay where
they are: both passes and the projection are narrow. Vectors of different lengths have fits of their
own, made in the same passes.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_length

#: Quantisation: floor(SCALE * entry) + SHIFT; entries beyond MOST in size count as MOST.
SCALE, SHIFT, MOST = 64, 1_000_000, float(1 << 60)
#: An eigenvalue's share of the largest below which it is rounding.
NOISE = 1e-12
LONG = (1 << 63) - 1


@dataclass
class Fit:
    """Of the vectors of one length: how many, exact sums, projection and eigenvalues by falling size."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    trace: float
    projection: np.ndarray  # columns: eigenvector over the root of its eigenvalue; NaN where that is noise

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.split()
        return (x - whole) - rest / self.n

    def split(self) -> tuple[np.ndarray, np.ndarray]:
        """S = n * whole + rest: differences to whole are exact, so nothing is lost to the shift."""
        return np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n for s in self.sums], np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over the dimensions of (n x - S)^2, exact; None where that is no long."""
        near = self.centred(x)
        if self.n**2 * float((near**2).sum(axis=1).max(initial=0.0)) < 2.0**62 and self.n * np.abs(near).max(initial=0.0) < 2.0**31:
            whole, _ = self.split()
            exact = self.n * (x - whole) - np.array([s % self.n for s in self.sums], np.int64)
            return (exact**2).sum(axis=1).tolist()
        found = (sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist())
        return [d if d <= LONG else None for d in found]


def quantised(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * vectors.astype(np.float64)), -MOST, MOST).astype(np.int64) + SHIFT


def _sums(batches):
    """One row: for each length n, and exact sums of the low and the high 32 bits of the integers."""
    held: dict[int, list] = {}
    for batch in batches:
        for rows, matrix in by_length(batch.column(0)):
            x = quantised(matrix)
            low, high = (x & 0xFFFFFFFF).sum(axis=0).tolist(), (x >> 32).sum(axis=0).tolist()
            n, sums = held.get(x.shape[1], (0, [0] * x.shape[1]))
            held[x.shape[1]] = (n + len(rows), [s + a + (b << 32) for s, a, b in zip(sums, low, high, strict=True)])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], names=["state"])


def _merge_sums(a: dict, b: dict) -> dict:
    for size, (n, sums) in b.items():
        m, own = a.get(size, (0, [0] * size))
        a[size] = (m + n, [s + t for s, t in zip(own, sums, strict=True)])
    return a


def _products(fits):
    """One row: for each length the sum of outer products of rows centred on the mean of all."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, matrix in by_length(batch.column(0)):
                y = fits.value[matrix.shape[1]].centred(quantised(matrix))
                held[y.shape[1]] = held.get(y.shape[1], 0.0) + y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], names=["state"])

    return run


def _merge_products(a: dict, b: dict) -> dict:
    for size, product in b.items():
        a[size] = a[size] + product if size in a else product
    return a


def _moments(fits):
    """One row: for each length n, mean and centred products of the whitened rows."""

    def run(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            for _, matrix in by_length(batch.column(0)):
                fit = fits.value[matrix.shape[1]]
                w = fit.centred(quantised(matrix)) @ fit.projection
                mean = w.mean(axis=0)
                held = _merge_moments(held, {matrix.shape[1]: (len(w), mean, (w - mean).T @ (w - mean))})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], names=["state"])

    return run


def _merge_moments(a: dict, b: dict) -> dict:
    for size, (n, mean, product) in b.items():
        if size not in a:
            a[size] = (n, mean, product)
            continue
        m, own, held = a[size]
        gap = mean - own
        a[size] = (m + n, own + gap * n / (m + n), held + product + np.outer(gap, gap) * (m * n / (m + n)))
    return a


def _tree(rows: DataFrame, run, merge) -> dict:
    """What `merge` leaves of the states of all tasks; the driver gets some of them, deeper trees for more."""
    states = rows.select("vector").mapInArrow(run, "state binary").rdd
    depth = max(2, int(np.ceil(np.log(max(2, states.getNumPartitions())) / np.log(16))))
    return states.treeAggregate({}, lambda held, r: merge(held, pickle.loads(r[0])), merge, depth)


def usable(rows: DataFrame, vector: str, key: str) -> DataFrame:
    """(key, vector) of rows whose vector is neither null nor holds null or non-finite entries."""
    column = F.col(vector)
    sound = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.select(F.col(key).alias("key"), column.cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & sound)


def fit(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 32) -> dict[int, Fit]:
    """The fit of each vector length; lengths of 0 have none. Nulls and non-finite entries take no part."""
    own = usable(rows, vector, key)
    context = rows.sparkSession.sparkContext
    fits = {size: Fit(n, sums, np.zeros(0), 0.0, np.zeros((size, 0))) for size, (n, sums) in _tree(own, _sums, _merge_sums).items()}
    if not fits:
        return fits
    for size, product in _tree(own, _products(context.broadcast(fits)), _merge_products).items():
        one = fits[size]
        values, vectors = np.linalg.eigh((product + product.T) / (2 * one.n))
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        # The sign is free: the largest entry of each is positive.
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
        real = values > NOISE * max(values.max(initial=0.0), 0.0)
        one.eigenvalues, one.trace = np.maximum(values, 0.0), float(np.trace(product) / one.n)
        one.projection = np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), np.nan)
    return fits


def identity_errors(rows: DataFrame, fits: dict[int, Fit], vector: str = "embedding", key: str = "vec_id") -> dict[int, float]:
    """The largest absolute entry of the whitened rows' covariance less the identity, by length;
    components without a real eigenvalue are left out."""
    if not fits:
        return {}
    found = _tree(usable(rows, vector, key), _moments(rows.sparkSession.sparkContext.broadcast(fits)), _merge_moments)
    errors = {}
    for size, (n, _, product) in found.items():
        real = ~np.isnan(fits[size].projection).any(axis=0)
        covariance = product[np.ix_(real, real)] / n
        errors[size] = float(np.abs(covariance - np.eye(len(covariance))).max(initial=0.0))
    return errors


def transform(rows: DataFrame, fits: dict[int, Fit], vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, whitened array, deviation) of every usable row; whitened has an entry for each component,
    null where its eigenvalue is no more than rounding."""
    held = rows.sparkSession.sparkContext.broadcast(fits)

    def run(batches):
        for batch in batches:
            for at, matrix in by_length(batch.column(1)):
                one, x = held.value[matrix.shape[1]], quantised(matrix)
                w = one.centred(x) @ one.projection
                values = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), values)
                size = pa.array(np.full(len(w), matrix.shape[1], np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), size, lists, pa.array(one.deviations(x), pa.int64())], names=["key", "size", "whitened", "deviation"])

    own = usable(rows, vector, key)
    kind = own.schema["key"].dataType.simpleString()
    return own.mapInArrow(run, f"key {kind}, size int, whitened array<double>, deviation long").withColumnRenamed("key", key)


def _of_length(values: dict[int, object], kind: str) -> Column:
    if not values:
        return F.lit(None).cast(kind)
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("size")].cast(kind)


def whitening_digests(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 32) -> DataFrame:
    """Per usable row and component (from 1): key, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries are left out, and so are empty
    vectors, which have no component; a null key stays, repeated rows count as rows, zero vectors as
    any other, an empty table gives no rows. Vectors of each length have a fit of their own. A
    component whose eigenvalue is 0 (but for rounding) has a null in whitened; deviation is null where
    it exceeds a long. Memory: for each task the square of a vector's length.
    """
    fits = fit(rows, vector, key, components)
    errors = identity_errors(rows, fits, vector, key)
    shares = {size: F.array(*[F.lit(float(e / one.trace)) if one.trace > 0 else F.lit(None).cast("double") for e in one.eigenvalues]) for size, one in fits.items()}
    explained = F.create_map(*[x for size, s in shares.items() for x in (F.lit(size), s)])[F.col("size")] if shares else F.array().cast("array<double>")
    wide = transform(rows, fits, vector, key).select(F.col(key), F.posexplode("whitened").alias("at", "whitened"), "deviation", "size")
    return wide.select(key, (F.col("at") + 1).cast("int").alias("component"), _of_length({s: f.n for s, f in fits.items()}, "long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), _of_length(errors, "double").alias("identity_error"))
