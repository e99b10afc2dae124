"""Whitening of integer vectors with exact second moments: digit-slice products, big-integer merges, one eigenproblem."""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._cluster import discard, released, unused, written

#: Bits of a limb and rows of a block: a sum of ROWS products of two limbs stays below 2**53, so float64 products are exact.
LIMB_BITS, ROWS = 18, 1 << 16
#: Merged integers travel as two decimals, high * 2**SPLIT_BITS + low, each far below 10**38 also after summing.
SPLIT_BITS = 60


def limbs(block: np.ndarray) -> list[np.ndarray]:
    """Float64 planes p with sum(p[k] << (LIMB_BITS * k)) == block, each |p| <= 2**(LIMB_BITS - 1) (digits are balanced).
    block holds 64-bit integers, or Python integers of any size as objects."""
    planes, rest, half = [], block, 1 << (LIMB_BITS - 1)
    while True:
        low = ((rest + half) & ((1 << LIMB_BITS) - 1)) - half
        planes.append(low.astype(np.float64))
        rest = (rest - low) >> LIMB_BITS
        if not rest.any():
            return planes


def gram(block: np.ndarray) -> np.ndarray:
    """block.T @ block as Python integers, by one float64 product for each pair of limb planes."""
    d = block.shape[1]
    total = np.zeros((d, d), object)
    for at in range(0, len(block), ROWS):
        planes = limbs(block[at : at + ROWS])
        for i, a in enumerate(planes):
            for j, b in enumerate(planes[: i + 1]):
                product = (a.T @ b).astype(np.int64).astype(object) << (LIMB_BITS * (i + j))
                total += product if i == j else product + product.T
    return total


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """A batch's vectors as rows of 64-bit integers, those of fewer entries filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), d), np.int64)
    inside = np.arange(d) < sizes[:, None]
    out[inside] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums: n times the centred vectors, as 64-bit integers where they fit and Python integers where not."""
    top = max(-int(x.min(initial=0)), int(x.max(initial=0))) * n + max((abs(int(s)) for s in sums), default=0)
    if top < 1 << 61:
        return x * np.int64(n) - sums.astype(np.int64)
    return x.astype(object) * n - sums


@dataclass(frozen=True)
class Whitening:
    """Fitted on n distinct vectors: per-dimension sums, eigenvalues (falling) and unit eigenvectors (columns) of the
    covariance, its trace, and the largest deviation of the whitened covariance from the identity."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def integer_vector(vector: Column, scale: int = 256) -> Column:
    """floor(scale * entry) of each entry taken as double, or null where the vector or an entry is null or not finite. Entries
    beyond 64 bits take the nearest 64-bit integer."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(finite, F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long")))


def _sum_rows(d: int) -> Callable:
    """Task: its vectors' sum in each dimension, as rows (k, s) of whole integers."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, object)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            total += x.sum(axis=0) if int(np.abs(x.astype(np.float64)).max(initial=0)) * len(x) < 1 << 61 else x.astype(object).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([decimal.Decimal(int(v)) for v in total], pa.decimal128(38, 0))], names=["k", "s"])

    return run


def _product_rows(n: int, sums: np.ndarray) -> Callable:
    """Task: the lower triangle of its vectors' centred second moments, as rows (i, j, high, low) of whole integers."""
    d, schema = len(sums), pa.schema([("i", pa.int32()), ("j", pa.int32()), ("high", pa.decimal128(38, 0)), ("low", pa.decimal128(38, 0))])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for batch in batches:
            total += gram(_centred(_matrix(batch.column(0), d), n, sums))
        at_i, at_j = np.tril_indices(d)
        entries = total[at_i, at_j]
        keep = np.flatnonzero(entries != 0)
        high, low = entries[keep] >> SPLIT_BITS, entries[keep] & ((1 << SPLIT_BITS) - 1)
        whole = [pa.array([decimal.Decimal(int(v)) for v in part], pa.decimal128(38, 0)) for part in (high, low)]
        yield pa.RecordBatch.from_arrays([pa.array(at_i[keep], pa.int32()), pa.array(at_j[keep], pa.int32()), *whole], schema=schema)

    return run


def fit_whitening(vectors: DataFrame, column: str, components: int = 4) -> Whitening:
    """Fit on each distinct vector of `column` (array<long>, no null) once.

    The driver meets d sums, d * (d + 1) / 2 moments and a matrix of `components` squared, whatever the number of rows.
    Vectors of fewer entries than the longest count as filled up with zeros.
    """
    d = vectors.agg(F.max(F.size(column))).first()[0] or 0
    filled = F.transform(F.sequence(F.lit(1), F.lit(d)), lambda k: F.coalesce(F.try_element_at(F.col(column), k), F.lit(0))) if d else F.col(column)
    x = F.when(F.size(column) == d, F.col(column)).otherwise(filled)
    distinct = written(vectors.select(x.alias("x")).distinct(), "distinct")  # partial distinct first: a common vector is one row a task
    n, sums = distinct.count(), np.zeros(d, object)
    for r in distinct.mapInArrow(_sum_rows(d), "k int, s decimal(38,0)").groupBy("k").agg(F.sum("s").alias("s")).collect():
        sums[r.k] = int(r.s)
    moments = np.zeros((d, d), object)
    if n and d:
        rows = distinct.mapInArrow(_product_rows(n, sums), "i int, j int, high decimal(38,0), low decimal(38,0)")
        for r in rows.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
            moments[r.i, r.j] = moments[r.j, r.i] = (int(r.high) << SPLIT_BITS) + int(r.low)
    # entries of sum((n x - S)(n x - S)') over n**3, each divided once as whole numbers and rounded once
    covariance = np.array([[int(v) / n**3 for v in row] for row in moments], float).reshape(d, d)
    values, axes = np.linalg.eigh(covariance) if d else (np.empty(0), np.empty((0, 0)))
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace = float(sum(int(moments[k, k]) for k in range(d)) / n**3) if n else 0.0
    model = Whitening(n, sums, np.where(values > d * np.finfo(float).eps * max(values, default=0), values, 0.0), axes, trace, 0.0)
    error = _identity_error(distinct, model)
    discard(distinct)
    return Whitening(model.n, model.sums, model.values, model.vectors, model.trace, error)


def _project(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """(centred integers, whitened coordinates); a component without variance has coordinate 0."""
    y = _centred(x, model.n, model.sums)
    scale = np.divide(1.0, np.sqrt(model.values), out=np.zeros_like(model.values), where=model.values > 0)
    return y, (y.astype(np.float64) / model.n) @ model.vectors * scale


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, over components with variance."""
    k, d = int((model.values > 0).sum()), len(model.sums)
    if not k:
        return 0.0

    @released
    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            total += _project(_matrix(batch.column(0), d), model)[1][:, :k].sum(axis=0)
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(k), pa.int32()), "s": total})

    mean = np.zeros(k)
    for r in distinct.mapInArrow(means, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():
        mean[r.k] = r.s / model.n

    @released
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = _project(_matrix(batch.column(0), d), model)[1][:, :k] - mean
            total += w.T @ w
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(k * k), pa.int32()), "s": total.ravel()})

    covariance = np.zeros(k * k)
    for r in distinct.mapInArrow(products, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():
        covariance[r.k] = r.s / model.n
    return float(np.abs(covariance.reshape(k, k) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """One row per remaining input row and component: id, component (from 1), n, deviation (decimal(38,0): the exact sum over
    dimensions of (n * x - S)**2), whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries go. The model is fitted on each distinct integer vector
    once (fit_whitening) and is bounded by the dimensions; rows are projected where they lie.

    Defined cases: a null id stays null; rows that repeat are each answered but fitted once; vectors of fewer entries than
    the longest count as filled up with zeros (an empty one is the zero vector); fewer dimensions than components give as
    many components as dimensions, and no row where all vectors are empty; components without variance (one vector, or
    fewer independent ones) have whitened 0, explained 0 and are left out of identity_error; of equal eigenvalues any basis
    may come; a deviation beyond 38 digits is null; extra columns are left out; an empty table gives an empty table.
    """
    [x] = unused(vectors, "x")
    rows = vectors.select(F.col(id_col).alias("id"), integer_vector(F.col(vector_col)).alias(x)).where(F.col(x).isNotNull())
    model = fit_whitening(rows, x, components)
    k, d = len(model.values), len(model.sums)
    id_type = rows.schema["id"].dataType.simpleString()
    explained = model.values / model.trace if model.trace > 0 else np.zeros(k)
    limit = 10**38

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, white = _project(_matrix(batch.column(1), d), model)
            if y.dtype == object or int(np.abs(y).max(initial=0)) ** 2 * d >= 1 << 62:
                deviation = (y.astype(object) ** 2).sum(axis=1)
            else:
                deviation = (y * y).sum(axis=1)
            deviation = [decimal.Decimal(int(v)) if v < limit else None for v in deviation]
            rows_of = np.repeat(np.arange(batch.num_rows), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows_of)), pa.array(np.tile(np.arange(1, k + 1), batch.num_rows), pa.int32()), pa.array(np.full(len(rows_of), model.n), pa.int64()),
                    pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(rows_of)), pa.array(white.ravel()), pa.array(np.tile(explained, batch.num_rows)), pa.array(np.full(len(rows_of), model.identity_error)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    ddl = f"id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    out = rows.mapInArrow(run, ddl) if k else rows.sparkSession.createDataFrame([], ddl)
    return out.withColumnRenamed("id", id_col)
