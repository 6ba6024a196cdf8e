"""Whitening of embeddings by their exact covariance, which is found by polarisation.

Entries become whole numbers. Squares are summed for every dimension and for the sum of every pair of
dimensions, centred first; as Var(a + b) = Var(a) + Var(b) + 2 Cov(a, b), differences of these variances are
the covariances. All sums are exact, so the order in which tasks finish changes nothing. Only numbers
of the size of the covariance matrix reach the driver, which finds its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearweave.llm.common import slices

# An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: floor(SCALE * c) is held within this, so that squares of sums of two stay within 38 digits.
LARGEST = 1 << 52
COMPONENTS = 8
#: A component has no spread if its eigenvalue is below this share of the largest.
NO_SPREAD = 1e-13
LONG = 1 << 63


@dataclass(frozen=True)
class Model:
    """What was fitted on the n vectors of one length: exact sums of each dimension, eigenvectors (rows) and
    eigenvalues by falling value, and each one's share of the whole variance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The whole parts of the means, and n times what they leave."""
        parts = [divmod(s, self.n) for s in self.sums]
        return np.array([m for m, _ in parts], np.int64), np.array([r for _, r in parts], np.int64)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, x) of the rows whose vector is not null and has finite entries only; x has doubles."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.select(F.col(key).cast("long").alias("id"), x.alias("x")).where(F.col("x").isNotNull() & finite)


def whole(x: np.ndarray) -> np.ndarray:
    """Entries as whole numbers."""
    return np.clip(np.floor(x * SCALE), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids, and the vectors as whole numbers, of the rows of a batch that have as many entries."""
    for batch in slices(batches, "x"):
        ids, x = batch.column("id"), batch.column("x")
        sizes = pc.list_value_length(x).to_numpy(zero_copy_only=False)
        for d in np.unique(sizes):
            rows = pa.array(np.flatnonzero(sizes == d))
            if d:
                yield ids.take(rows), whole(x.take(rows).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), d))


def square_sums(y: np.ndarray) -> list[int]:
    """Exact sums over the rows of y of (y_i + y_j) squared, for i <= j row by row; y_i itself where i = j."""
    most = 2 * max(abs(int(y.max())), abs(int(y.min())))
    y = y if most * most * len(y) < LONG else y.astype(object)
    out: list[int] = []
    for i in range(y.shape[1]):
        pair = y[:, i:] + y[:, i : i + 1]
        pair[:, 0] = y[:, i]
        out += (pair * pair).sum(axis=0).tolist()
    return out


def _summed(rows: DataFrame, make) -> dict[int, dict[int, int]]:
    """Exact totals of make(matrix), a list of whole numbers, over all rows, by the vectors' length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[int]] = {}
        for _, x in matrices(batches):
            made, d = make(x), x.shape[1]
            totals[d] = [a + b for a, b in zip(totals[d], made)] if d in totals else made
        for d, values in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * len(values), pa.int32()), pa.array(range(len(values)), pa.int64()), pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))],
                names=["d", "k", "v"],
            )

    out: dict[int, dict[int, int]] = {}
    for r in rows.mapInArrow(run, "d int, k long, v decimal(38,0)").groupBy("d", "k").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r["d"], {})[r["k"]] = int(r["v"])
    return out


def covariance(n: int, sums: list[int], squares: list[int]) -> np.ndarray:
    """The covariance matrix from square_sums of values less the whole parts of their means.

    With S = n m + r, the sum of (n x - S)^2 is n^2 times that of (x - m)^2, less n r^2; and so for sums of two
    dimensions. These are whole numbers; only the last division rounds.
    """
    d = len(sums)
    rest = [s % n for s in sums]
    exact: dict[tuple[int, int], int] = {}
    pairs = iter(squares)
    for i in range(d):
        for j in range(i, d):
            r = rest[i] if i == j else rest[i] + rest[j]
            exact[i, j] = n * n * next(pairs) - n * r * r
    out = np.empty((d, d))
    for (i, j), q in exact.items():
        twice = 2 * q if i == j else q - exact[i, i] - exact[j, j]
        out[i, j] = out[j, i] = float(Fraction(twice, 2 * n**3))
    return out


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length of the vectors in rows (see usable). Reads rows twice; what reaches the driver has the
    size of the models. Vectors of other lengths have no covariance with each other."""
    counts = _summed(rows, lambda x: [len(x), *map(int, x.astype(object).sum(axis=0) if len(x) * (LARGEST + SHIFT) >= LONG else x.sum(axis=0))])
    n = {d: v[0] for d, v in counts.items()}
    sums = {d: [v[k + 1] for k in range(d)] for d, v in counts.items()}
    middle = {d: np.array([s // n[d] for s in sums[d]], np.int64) for d in n}
    squares = _summed(rows, lambda x: square_sums(x - middle[x.shape[1]]))
    out = {}
    for d in n:
        v = covariance(n[d], sums[d], [squares[d][k] for k in range(d * (d + 1) // 2)])
        values, vectors = np.linalg.eigh(v)
        top = np.argsort(values)[::-1][: min(components, d)]
        trace = float(np.trace(v))
        values = values[top]
        values = np.where(values > NO_SPREAD * max(values[0], 0), values, 0.0)
        out[d] = Model(n[d], tuple(sums[d]), np.ascontiguousarray(vectors[:, top].T), values, values / trace if trace > 0 else values * 0.0)
    return out


def projected(model: Model, x: np.ndarray) -> np.ndarray:
    """Whitened values of vectors of whole numbers, NaN for components without spread."""
    middle, rest = model.centre()
    scale = np.where(model.values > 0, model.values, np.nan) ** -0.5
    return ((x - middle) - rest / model.n) @ model.components.T * scale


def deviations(model: Model, x: np.ndarray) -> list[int | None]:
    """The sum over dimensions of (n x - S)^2, exactly; None where it does not fit a long."""
    middle, rest = model.centre()
    y = x - middle
    most = model.n * (max(abs(int(y.max())), abs(int(y.min()))) + 1)
    if most * most * x.shape[1] < LONG:
        y = y * model.n - rest
        return (y * y).sum(axis=1).tolist()
    y = y.astype(object) * model.n - rest.astype(object)
    return [v if v < LONG else None for v in (y * y).sum(axis=1).tolist()]


def identity_error(rows: DataFrame, models: dict[int, Model]) -> float:
    """The largest absolute entry of the covariance of all whitened rows, less the identity: measured by one more
    pass over them. Components without spread are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for _, x in matrices(batches):
            d = x.shape[1]
            w = np.column_stack([np.ones(len(x)), projected(shared.value[d], x)])
            totals[d] = totals.get(d, 0.0) + w.T @ w
        for d, t in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * t.size, pa.int32()), pa.array(range(t.size), pa.int32()), pa.array(t.ravel())], names=["d", "k", "v"])

    found = rows.mapInArrow(run, "d int, k int, v double").groupBy("d", "k").agg(F.sum("v").alias("v")).collect()
    worst = 0.0
    for d, model in models.items():
        t = np.zeros((len(model.values) + 1,) * 2)
        for r in found:
            if r["d"] == d:
                t.flat[r["k"]] = r["v"]
        mean = t[0, 1:] / model.n
        spread = np.flatnonzero(model.values > 0)
        error = t[1:, 1:] / model.n - np.outer(mean, mean) - np.eye(len(mean))
        worst = max(worst, float(np.abs(error[np.ix_(spread, spread)]).max(initial=0.0)))
    return worst


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per row of vectors and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries, or has none at all, are left out; repeated rows and
    rows without an id each count and come back. Vectors of each length are whitened among themselves; n is their
    number. A component without spread (fewer different vectors than dimensions) has a null for whitened and 0 for
    explained. deviation is null where it does not fit a long. Entries beyond LARGEST / SCALE count as that. Other
    columns are not read; an empty table gives no rows.
    """
    rows = usable(vectors, key, vector)
    models = fit(rows, components)
    error = identity_error(rows, models)
    shared = vectors.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in matrices(batches):
            model = shared.value[x.shape[1]]
            m, k = len(x), len(model.values)
            each = pa.array(np.repeat(np.arange(m), k))
            values = projected(model, x).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)),
                    pa.array(deviations(model, x), pa.int64()).take(each), pa.array(values, mask=np.isnan(values)), pa.array(np.tile(model.explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
