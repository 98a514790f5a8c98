"""Whitening of vectors by shifted CholeskyQR.

Entries become whole numbers x = floor(64 c) + 1000000 (beyond 2^53 they stay at 2^53). The rows, centred by their
exact sums, are never held together: each pass sums one Gram matrix, over rows in tasks and over tasks by Spark.
Pass 1 factors the Gram matrix plus a small shift, so that it succeeds however badly the columns are scaled. Passes 2 and 3
go over the rows solved through the triangular factors so far, and factor again; a shift is added only where
a factor does not exist (columns that depend on each other). With R = R3 R2 R1 the centred rows are Q R with
orthonormal Q, so the singular values of R give the eigenvalues of the covariance without ever squaring its condition, and the right
singular vectors the components. A fourth pass measures the covariance of the whitened rows.

Only matrices of the size dimensions x dimensions reach the driver. Passes read one stored table, so each of them sees the same rows.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped, and so are empty vectors (no
dimension, no component); vectors of different lengths are fitted apart, each with its own n (a pass for each length, so
meant for few lengths); null ids and repeated rows are kept; a component without variance (fewer independent rows than components,
constant dimensions) has whitened null and explained 0, or null where nothing varies; a deviation that no long holds is null;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.session import stored

SCALE, LIFT = 64, 1_000_000
COMPONENTS = 32
_LARGEST = 1 << 53
_LOW_BITS = 26
_SOLVE_COLUMNS = 32
#: Eigenvalues below this share of the largest are no variance but rounding.
RANK_SHARE = 1e-13


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(finite & (F.size(v) > 0), F.lit(False))


def whole_numbers(c: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * c), -_LARGEST, _LARGEST).astype(np.int64) + LIFT


def _rows(batch: pa.RecordBatch, column: int, dim: int) -> np.ndarray:
    return whole_numbers(batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def solve_right(z: np.ndarray, r: np.ndarray) -> np.ndarray:
    """z R^-1 for an upper triangular R, by substitution in blocks of columns."""
    q, dim = np.array(z, np.float64), len(r)
    for start in range(0, dim, _SOLVE_COLUMNS):
        stop = min(start + _SOLVE_COLUMNS, dim)
        if start:
            q[:, start:stop] -= q[:, :start] @ r[:start, start:stop]
        for j in range(start, stop):
            if j > start:
                q[:, j] -= q[:, start:j] @ r[start:j, j]
            q[:, j] /= r[j, j]
    return q


class Centre:
    """Exact sums of a table's rows, and rows less their mean."""

    def __init__(self, n: int, sums: list[int], low: list[int], high: list[int]) -> None:
        self.n, self.sums = n, sums
        spans = [max(abs(n * a - s), abs(n * b - s)) for a, b, s in zip(low, high, sums)]
        widest = max([n * max(abs(a), abs(b)) for a, b in zip(low, high)] + [abs(s) for s in sums])
        self.wide = widest >= 1 << 62 or sum(s * s for s in spans) >= 1 << 63  # beyond what a long holds

    def differences(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        if self.wide:
            return x.astype(object) * self.n - np.array(self.sums, object)
        return x * np.int64(self.n) - np.array(self.sums, np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.differences(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        d = self.differences(x)
        found = (d * d).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in found] if self.wide else found


def centre(vectors: DataFrame, dim: int) -> Centre:
    """Sums per dimension: counted per task in two halves of a number, so that they stay exact, then by Spark."""
    low_part = (1 << _LOW_BITS) - 1

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, parts = 0, np.zeros((2, dim), np.int64)
        low, high = np.full(dim, np.iinfo(np.int64).max), np.full(dim, np.iinfo(np.int64).min)
        for batch in batches:
            x = _rows(batch, 0, dim)
            if len(x):
                n += len(x)
                parts += [(x >> _LOW_BITS).sum(axis=0), (x & low_part).sum(axis=0)]
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if n:
            yield pa.record_batch([pa.array(np.arange(dim)), pa.array(np.full(dim, n)), *map(pa.array, (*parts, low, high))],
                                  names=["pos", "n", "upper", "lower", "low", "high"])

    schema = "pos bigint, n bigint, upper bigint, lower bigint, low bigint, high bigint"
    rows = vectors.select("v").mapInArrow(tally, schema).groupBy("pos").agg(
        F.sum("n").alias("n"), F.sum("upper").alias("upper"), F.sum("lower").alias("lower"),
        F.min("low").alias("low"), F.max("high").alias("high")).orderBy("pos").collect()
    return Centre(rows[0]["n"], [(r["upper"] << _LOW_BITS) + r["lower"] for r in rows],
                  [r["low"] for r in rows], [r["high"] for r in rows])


def gram(vectors: DataFrame, dim: int, width: int, rows: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of y^T y over the rows y that ``rows`` makes of a table's whole-number rows."""
    upper = np.triu_indices(width)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros((width, width)), False
        for batch in batches:
            if batch.num_rows:
                y = rows(_rows(batch, 0, dim))
                total += y.T @ y
                any_row = True
        if any_row:
            yield pa.record_batch([pa.array(upper[0] * width + upper[1]), pa.array(total[upper])], names=["cell", "value"])

    cells = vectors.select("v").mapInArrow(multiply, "cell bigint, value double").groupBy("cell").agg(
        F.sum("value").alias("value")).orderBy("cell").toArrow()
    out = np.zeros((width, width))
    out[upper] = cells.column("value").to_numpy()
    return out + np.triu(out, 1).T


def factor(g: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper triangular R with R^T R = g; with the shift of shifted CholeskyQR if asked for or needed."""
    dim = len(g)
    if not shifted:
        try:
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            pass
    shift = 11 * (n * dim + dim * (dim + 1)) * np.finfo(np.float64).eps / 2 * np.trace(g)
    return np.linalg.cholesky(g + max(shift, 1e-300) * np.eye(dim)).T


def fit(vectors: DataFrame, dim: int, components: int = COMPONENTS) -> tuple[Centre, np.ndarray, np.ndarray, float]:
    """(centre, unit eigenvectors as columns, all eigenvalues falling, trace) of the covariance of the table's rows."""
    middle = centre(vectors, dim)
    factors: list[np.ndarray] = []
    for number in range(3):
        known = list(factors)

        def solved(x: np.ndarray, known: list[np.ndarray] = known) -> np.ndarray:
            y = middle.rows(x)
            for r in known:
                y = solve_right(y, r)
            return y

        g = gram(vectors, dim, dim, solved)
        if not number:
            trace = float(np.trace(g)) / middle.n
            if not trace:
                return middle, np.eye(dim)[:, :components], np.zeros(dim), 0.0
        factors.append(factor(g, middle.n, shifted=not number))
    whole = factors[2] @ factors[1] @ factors[0]
    _, sizes, turned = np.linalg.svd(whole / np.sqrt(middle.n))
    values = sizes**2
    values[values <= RANK_SHARE * values[0]] = 0.0
    return middle, turned[:components].T, values, trace


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) for every usable vector and component."""
    v = F.col("embedding").cast("array<double>")
    usable = stored(vectors.select("vec_id", v.alias("v")).where(_usable(F.col("v"))), "vectors")
    id_type = usable.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double")
    parts = [_whitened(usable.where(F.size("v") == dim), dim, components, schema)
             for dim in sorted(r[0] for r in usable.select(F.size("v")).distinct().collect())]
    out = vectors.sparkSession.createDataFrame([], schema)
    for part in parts:
        out = out.unionByName(part)
    return out


def _whitened(vectors: DataFrame, dim: int, components: int, schema: str) -> DataFrame:
    middle, axes, values, trace = fit(vectors, dim, components)
    shown = axes.shape[1]
    live = values[:shown] > 0
    width = int(live.sum())  # eigenvalues fall, so these come first
    scaled = axes[:, :width] / np.sqrt(values[:width])

    def project(x: np.ndarray) -> np.ndarray:
        return middle.rows(x) @ scaled

    error = float(np.abs(gram(vectors, dim, width, project) / middle.n - np.eye(width)).max()) if width else 0.0
    explained = [float(e) / trace if trace else None for e in values[:shown]]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                x, k = _rows(part, 1, dim), part.num_rows
                if not k:
                    continue
                y = np.full((k, shown), np.nan)
                y[:, :width] = project(x)
                numbers = np.tile(np.arange(1, shown + 1, dtype=np.int32), k)
                at = pa.array(np.repeat(np.arange(k), shown))
                yield pa.record_batch(
                    [part.column(0).take(at), pa.array(numbers), pa.array(np.full(k * shown, middle.n)),
                     pa.array(middle.deviations(x), pa.int64()).take(at), pa.array(y.reshape(-1), from_pandas=True),
                     pa.array(explained * k, pa.float64()), pa.array(np.full(k * shown, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select("vec_id", "v").mapInArrow(emit, schema)
