"""Whitening of embeddings by shifted Cholesky QR.

The centred rows are never brought together.  A pass multiplies them into a Gram matrix, whose
Cholesky factor R makes the rows closer to orthonormal: the next pass solves ``row = q R`` for q
before it multiplies.  The first factor is taken of the Gram matrix plus a small multiple of the
identity, so that it exists at any condition number; the passes end when the rows are orthonormal.
The product of the factors has the singular values and right vectors of the centred rows, and a
small SVD of it gives the components without squaring their condition number.

Only matrices of dimension x dimension values reach the driver; dimensions above ``MAX_DIMENSION``
are an error.  Sums and deviations are exact integers.

Defined results: rows whose vector is null, or holds a null or non-finite entry, or an entry beyond
2**40, are left out, as are vectors of another length than the most frequent one (the longest of
equals).  Repeated rows count as often as they occur.  Components without variance (rank-deficient,
constant or empty tables) are not returned.  A deviation beyond a 64-bit integer is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DIMENSION = 2048
MAX_PASSES = 8
SCALE, OFFSET, LARGEST = 1024, 100_000, 1 << 40
# A component with less than this share of the first one's variance is rounding noise.
LEAST_SHARE = 1e-13
ROUNDING = float(np.finfo(np.float64).eps) / 2


@dataclass(frozen=True)
class Centre:
    """Rows, and the exact sum of every dimension."""

    n: int
    sums: tuple[int, ...]

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole and remaining part of each mean: ``sum = whole * n + rest``."""
        pairs = [divmod(s, self.n) for s in self.sums]
        return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)


@dataclass(frozen=True)
class Whitening:
    """Components as columns, their variances, and the largest departure from the identity."""

    centre: Centre
    components: np.ndarray
    variances: np.ndarray
    trace: float
    passes: int
    identity_error: float = field(default=0.0)


def scaled(vectors: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the usable rows, their integer vectors)."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), -1))
    rows = np.flatnonzero(lengths == dimension)
    flat = vectors.take(pa.array(rows)).flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dimension)
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.floor(SCALE * values)
        usable = (np.abs(whole) <= LARGEST).all(axis=1)
    return rows[usable], whole[usable].astype(np.int64) + OFFSET


def centred(x: np.ndarray, centre: Centre) -> np.ndarray:
    whole, rest = centre.parts()
    return (x - whole).astype(np.float64) - rest / centre.n


def solved(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """The q of ``rows = q upper``, by substitution over the columns."""
    q = np.empty_like(rows)
    for j in range(rows.shape[1]):
        q[:, j] = (rows[:, j] - q[:, :j] @ upper[:j, j]) / upper[j, j]
    return q


def deviations(x: np.ndarray, centre: Centre) -> list[int | None]:
    """Sum over the dimensions of (n x - S)^2, exactly; None beyond 64 bits."""
    whole, rest = centre.parts()
    apart = x - whole
    largest = int(np.abs(apart).max(initial=0)) * centre.n + centre.n
    if largest * largest * max(1, x.shape[1]) < 1 << 62:
        y = apart * centre.n - rest
        return (y * y).sum(axis=1).tolist()
    y = apart.astype(object) * centre.n - rest.astype(object)
    return [int(v) if v < 1 << 63 else None for v in (y * y).sum(axis=1)]


def _vectors(rows: DataFrame, vector: str) -> DataFrame:
    return rows.select(F.col(vector).cast("array<double>").alias("v"))


def centre_of(rows: DataFrame, vector: str = "embedding") -> Centre:
    """Row count and sums of the usable rows of the most frequent length."""
    usable = F.forall("v", lambda e: F.coalesce(F.abs(e) * SCALE <= LARGEST, F.lit(False)) & ~F.isnan(e))
    lengths = _vectors(rows, vector).filter(F.col("v").isNotNull() & usable).groupBy(F.size("v").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    if not most:
        return Centre(0, ())
    dimension = most[0]["length"]
    if dimension > MAX_DIMENSION:
        raise ValueError(f"vectors of {dimension} dimensions; at most {MAX_DIMENSION} are supported")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dimension, 0
        for batch in batches:
            _, x = scaled(batch.column(0), dimension)
            n += len(x)
            total = [t + s for t, s in zip(total, (x.sum(axis=0, dtype=np.int64)).tolist(), strict=True)]
        values = pa.array([Decimal(v) for v in [n, *total]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dimension), pa.int32()), values], names=["at", "value"])

    found = _vectors(rows, vector).mapInArrow(sums, "at int, value decimal(38,0)").groupBy("at").agg(F.sum("value").alias("value"))
    by_place = {r["at"]: int(r["value"]) for r in found.collect()}
    return Centre(by_place.get(-1, 0), tuple(by_place.get(j, 0) for j in range(dimension)))


def gram(rows: DataFrame, vector: str, centre: Centre, factors: list[np.ndarray], onto: np.ndarray | None = None) -> np.ndarray:
    """Gram matrix of the centred rows after the triangular solves, or of their projection ``onto`` columns."""
    dimension = len(centre.sums)
    width = dimension if onto is None else onto.shape[1]
    upper = np.triu_indices(width)
    places = pa.array(upper[0] * width + upper[1], pa.int32())

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            q = centred(scaled(batch.column(0), dimension)[1], centre)
            for factor in factors:
                q = solved(q, factor)
            if onto is not None:
                q = q @ onto
            total += q.T @ q
        yield pa.RecordBatch.from_arrays([places, pa.array(total[upper])], names=["at", "value"])

    sums = _vectors(rows, vector).mapInArrow(multiply, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros((width, width))
    for at, value in sums.collect():
        out[at // width, at % width] = out[at % width, at // width] = value
    return out


def shifted_factor(g: np.ndarray, n: int, *, shift: bool) -> np.ndarray:
    """Upper Cholesky factor of ``g``, shifted by its rounding error if asked for or needed."""
    dimension = len(g)
    if not shift:
        try:
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            pass
    by = 11 * (n * dimension + dimension * (dimension + 1)) * ROUNDING * float(np.linalg.eigvalsh(g)[-1])
    while True:
        try:
            return np.linalg.cholesky(g + by * np.eye(dimension)).T
        except np.linalg.LinAlgError:
            by *= 10


def fit(rows: DataFrame, vector: str = "embedding", components: int = 8) -> Whitening:
    """Fit on all usable rows of ``rows``."""
    centre = centre_of(rows, vector)
    dimension = len(centre.sums)
    none = Whitening(centre, np.zeros((dimension, 0)), np.zeros(0), 0.0, 0)
    if not centre.n or not dimension:
        return none
    factors: list[np.ndarray] = []
    whole = np.eye(dimension)
    for k in range(MAX_PASSES):
        g = gram(rows, vector, centre, factors)
        if not g.any():
            return none
        factors.append(shifted_factor(g, centre.n, shift=k == 0))
        whole = factors[-1] @ whole
        # Cholesky of a matrix this near to the identity is exact to rounding; directions without
        # variance stay near zero.
        values = np.linalg.eigvalsh(g)
        if k and (np.minimum(np.abs(values - 1), np.abs(values)) < 1e-8).all():
            break
    _, singular, right = np.linalg.svd(whole)
    variances = singular**2 / centre.n
    kept = int((variances[:components] > LEAST_SHARE * variances[0]).sum())
    model = Whitening(centre, right[:kept].T.copy(), variances[:kept], float(variances.sum()), len(factors))
    white = gram(rows, vector, centre, [], model.components / np.sqrt(model.variances)) / centre.n
    return Whitening(centre, model.components, model.variances, model.trace, model.passes, float(np.abs(white - np.eye(kept)).max(initial=0.0)))


def whiten(rows: DataFrame, model: Whitening, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row per usable row and component."""
    source = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    kind = source.schema["vec_id"].dataType.simpleString()
    centre, dimension, width = model.centre, len(model.centre.sums), model.components.shape[1]
    scale = model.components / np.sqrt(model.variances)
    explained = model.variances / model.trace if width else model.variances

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if width else ():
            kept, x = scaled(batch.column(1), dimension)
            repeat = pa.array(np.repeat(np.arange(len(kept)), width))
            size = len(kept) * width
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(kept)).take(repeat),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(kept))),
                    pa.array(np.full(size, centre.n, np.int64)),
                    pa.array(deviations(x, centre), pa.int64()).take(repeat),
                    pa.array((centred(x, centre) @ scale).ravel()),
                    pa.array(np.tile(explained, len(kept))),
                    pa.array(np.full(size, model.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return source.mapInArrow(project, schema)
