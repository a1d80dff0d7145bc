"""Whitening of vectors by a pivoted Cholesky factor of their scatter and one-sided Jacobi rotations of it.

The scatter is summed over the distinct whole-number vectors in passes of Spark:
first their number and sums, then, moved by the rounded mean so that numbers are
small, their products. Tasks add up exact products of a batch and return one row of
sums per dimension; these are added per dimension, and only a matrix of the width
of a vector reaches the driver. There,

* the covariance V is factored as P V P' = L L' with the largest remaining diagonal
  entry as pivot, which also tells its rank;
* columns of P' L are rotated in pairs until all are orthogonal (one-sided Jacobi, on
  the triangular factor itself and never on V): their squared norms are eigenvalues
  of V and the normalised columns its eigenvectors.

A last pass over the distinct vectors measures the covariance of what was whitened.

Cases: vectors that are null or hold null or non-finite entries are dropped, and so
are those with an entry that, times ``factor``, leaves 64 bits; shorter vectors count
as padded with zeros; repeated rows are fitted once and each get their rows, and so
do rows without an id; components whose eigenvalue is zero in double precision do
not exist, so fewer than asked may be returned, none for a single distinct vector;
ties of eigenvalues stay in the order of the factor's columns; the largest
coordinate of a component is positive; a deviation beyond 64 bits is null; an empty
table gives no row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import cut, map_arrow, query, table

COMPONENTS, FACTOR, OFFSET = 16, 64.0, 1_000_000
#: Products up to this are summed exactly in double precision.
EXACT = float(1 << 53)
#: Sweeps of rotations at most; ten are usual for widths of some hundred.
SWEEPS = 60


def whole(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", factor: float = FACTOR, offset: int = OFFSET) -> DataFrame:
    """vec_id, x: floor(factor * entry) + offset of each entry, for the vectors that take part."""
    fits = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * factor) < 2.0**62))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    return rows.filter(F.col("v").isNotNull() & fits).select("vec_id", F.transform("v", lambda c: F.floor(c * factor) + F.lit(offset)).alias("x"))


def matrix(column: pa.Array, width: int, filler: int) -> np.ndarray:
    """The vectors of a column as rows of whole numbers; what shorter ones lack is ``filler``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(np.asarray(column.offsets))
    values = np.asarray(column.flatten(), np.int64)
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.full((len(lengths), width), filler, np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _sums(rows: DataFrame, width: int, function) -> np.ndarray:
    """The sum over all batches of the matrices (rows x width) that ``function`` makes of them, added dimension by dimension.

    Sums are kept in extended precision, which holds whole numbers of 64 bits, and travel as two doubles.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            own = function(batch).astype(np.longdouble)
            total = own if total is None else total + own
        if total is not None:
            yield _split(np.arange(len(total)), total)

    def add(group: pa.Table) -> pa.Table:
        total = sum(
            np.asarray(h.values, np.float64).astype(np.longdouble) + np.asarray(s.values, np.float64).astype(np.longdouble)
            for h, s in zip(group["high"], group["low"])
        )
        return pa.Table.from_batches([_split(np.asarray(group["i"])[:1], total[None, :])])

    schema = "i long, high array<double>, low array<double>"
    found = map_arrow(rows, part, schema).groupBy("i").applyInArrow(add, schema).collect()
    found = sorted(found, key=lambda r: r.i)
    return np.array([np.array(r.high, np.longdouble) + np.array(r.low, np.longdouble) for r in found]).reshape(len(found), -1)


def _split(i: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    high = values.astype(np.float64)
    low = (values - high).astype(np.float64)
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1) * values.shape[1], pa.int32()), pa.array(m.ravel())) for m in (high, low)]
    return pa.RecordBatch.from_arrays([pa.array(i), *lists], names=["i", "high", "low"])


def _products(d: np.ndarray) -> np.ndarray:
    """d' d, exact where its entries are small whole numbers."""
    most = float(np.abs(d).max()) if d.size else 0.0
    if most * most * len(d) < EXACT:
        return d.T @ d
    wide = d.astype(np.longdouble)
    return wide.T @ wide


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows and lower triangular factor, one column per unit of rank: v[order][:, order] = factor @ factor.T."""
    n = len(v)
    a, order = v.copy(), np.arange(n)
    factor = np.zeros((n, n))
    least = n * np.finfo(float).eps * max(float(np.diag(v).max()) if n else 0.0, 0.0)
    for k in range(n):
        rest = np.diag(a)[k:]
        p = k + int(rest.argmax())
        if not rest.max() > least:
            return order, factor[:, :k]
        for m in (a, factor):
            m[[k, p]] = m[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1 :, k] = a[k + 1 :, k] / factor[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return order, factor


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs in which every two columns meet once: all but the first move round a table."""
    seats = list(range(n + n % 2))
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(min(i, j), max(i, j)) for i, j in zip(seats[:half], reversed(seats[half:])) if max(i, j) < n]
        yield np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
        seats = [seats[0], seats[-1], *seats[1:-1]]


def jacobi(factor: np.ndarray) -> np.ndarray:
    """The columns of ``factor`` rotated until they are orthogonal to each other, in falling order of their norms."""
    a = factor.copy()
    n = a.shape[1]
    tolerance = np.finfo(float).eps * max(1.0, np.sqrt(len(a)))
    for _ in range(SWEEPS):
        most = 0.0
        for i, j in _rounds(n):
            x, y = a[:, i], a[:, j]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            scale = np.sqrt(xx * yy)
            angle = np.divide(np.abs(xy), scale, out=np.zeros_like(xy), where=scale > 0)
            most = max(most, float(angle.max(initial=0.0)))
            turn = angle > tolerance
            zeta = np.divide(yy - xx, 2 * xy, out=np.zeros_like(xy), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1.0 / np.hypot(1.0, t)
            a[:, i], a[:, j] = c * x - c * t * y, c * t * x + c * y
        if most <= tolerance:
            break
    else:
        raise RuntimeError(f"columns are not orthogonal after {SWEEPS} sweeps")
    norm = (a * a).sum(axis=0)
    return a[:, np.argsort(-norm, kind="stable")]


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance ``v`` by falling size, and its unit eigenvectors as columns."""
    order, factor = pivoted_cholesky(v)
    turned = np.empty_like(factor)
    turned[order] = jacobi(factor)
    values = (turned * turned).sum(axis=0)
    axes = turned / np.sqrt(values)
    sign = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return values, axes * sign


class Whitening:
    """What was fitted: number, sums and centre of the distinct vectors, covariance, eigenvalues and components (columns)."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, axes: np.ndarray, trace: float, filler: int):
        self.n, self.sums, self.values, self.axes, self.trace, self.filler = n, sums, values, axes, trace, filler
        self.centre = np.array([_rounded(s, n) for s in sums], np.int64)
        # what the mean is beside the centre: the rest of the sums, exactly
        self.rest = np.array([s - n * int(c) for s, c in zip(sums, self.centre)], np.int64)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        centred = (x - self.centre).astype(float) - self.rest / self.n
        return centred @ (self.axes / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) squared, exactly; null beyond 64 bits."""
        moved = x - self.centre
        most = (float(np.abs(moved).max(initial=0)) * self.n + self.n) ** 2 * max(1, x.shape[1])
        if most < 2.0**63:
            own = self.n * moved - self.rest
            return (own * own).sum(axis=1).tolist()
        own = self.n * moved.astype(object) - self.rest.astype(object)
        return [s if s < 1 << 63 else None for s in (own * own).sum(axis=1).tolist()]


def _rounded(s: int, n: int) -> int:
    return (2 * s + n) // (2 * n)


def fit(distinct: DataFrame, most: int = COMPONENTS, filler: int = OFFSET) -> Whitening | None:
    """Whitening of the vectors ``x`` of a table that holds each once; none where nothing varies."""
    width = distinct.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return None

    def add(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column(0), width, filler).astype(np.longdouble)
        return np.concatenate([x.sum(axis=0), [len(x)]])[None, :]

    total = _sums(distinct, width + 1, add)[0]
    n, sums = int(total[-1]), [int(s) for s in total[:-1]]
    centre = np.array([_rounded(s, n) for s in sums], np.int64)

    def multiply(batch: pa.RecordBatch) -> np.ndarray:
        return _products((matrix(batch.column(0), width, filler) - centre).astype(float))

    moved = _sums(distinct, width, multiply)
    rest = np.array([s - n * int(c) for s, c in zip(sums, centre)], np.longdouble)
    v = ((moved - np.outer(rest, rest) / n) / n).astype(float)
    v = (v + v.T) / 2
    values, axes = components(v)
    return Whitening(n, sums, values[:most], axes[:, :most], float(np.trace(v)), filler) if len(values) else None


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance, the identity subtracted."""
    k = len(model.values)

    def multiply(batch: pa.RecordBatch) -> np.ndarray:
        w = model.whiten(matrix(batch.column(0), len(model.sums), model.filler))
        return np.concatenate([w.T @ w, w.sum(axis=0)[None, :]])

    total = _sums(distinct, k, multiply) / model.n
    covariance = total[:k] - np.outer(total[k], total[k])
    return float(np.abs(covariance - np.eye(k)).max())


def distinct_vectors(rows: DataFrame, filler: int = OFFSET) -> DataFrame:
    """Each vector ``x`` once, written once; vectors that differ only in what shorter ones lack are one."""
    width = F.lit(rows.agg(F.max(F.size("x"))).first()[0] or 0)
    padded = F.concat("x", F.array_repeat(F.lit(filler).cast("long"), width - F.size("x")))
    return cut(rows.select(F.when(F.size("x") < width, padded).otherwise(F.col("x")).alias("x")).distinct())


def whitened(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row and component."""
    rows = whole(vectors)
    distinct = distinct_vectors(rows)
    model = fit(distinct, most)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error, k = identity_error(distinct, model), len(model.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explained = model.values / model.trace
        for batch in batches:
            x = matrix(batch.column(1), len(model.sums), model.filler)
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array([d for d in model.deviations(x) for _ in range(k)], pa.int64()),
                    pa.array(model.whiten(x).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return map_arrow(rows, project, schema)


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
