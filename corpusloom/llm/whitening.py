"""Whitening of embedding vectors. The covariance is divided by spectral projectors: the polar factor of the shifted
matrix, found by dynamically weighted Halley iterations, tells the directions above the shift from those below, and
both invariant subspaces are divided again until they hold single components. The components are then broadcast.

The rows are summed in tasks; only sums, and one matrix of the vectors' dimension, reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import use_shared_folder

#: Entries become whole numbers: floor(SCALE * entry) + OFFSET.
SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Bound of the matrix on the driver and of what is broadcast; longer vectors are refused.
MAX_DIMENSION = 4096
#: Whole numbers beyond this size count as this size, so that sums of a batch fit 64 bits.
LARGEST = 1 << 48
_ROWS = 8192
_EPSILON = float(np.finfo(float).eps)


def polar_factor(a: np.ndarray, max_rounds: int = 30) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix; in exact arithmetic the sign of each eigenvalue.

    Halley's iteration with the weights that are best for singular values in [low, 1]. Steps with large weights are
    taken through a QR factorisation, which keeps them stable, the later ones by solving with a well-conditioned matrix.
    """
    size = len(a)
    eye = np.eye(size)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    try:
        low = 1 / (np.linalg.norm(np.linalg.inv(x), 1) * np.sqrt(size))
    except np.linalg.LinAlgError:
        low = _EPSILON
    low = min(max(float(low), _EPSILON / 4), 1.0)
    for _ in range(max_rounds):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        alpha = root + np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * root), 0.0)) / 2
        beta = (alpha - 1) ** 2 / 4
        gamma = alpha + beta - 1
        share = beta / gamma
        if gamma > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(gamma) * x, eye]))
            after = share * x + (alpha - share) / np.sqrt(gamma) * q[:size] @ q[size:].T
        else:
            after = share * x + (alpha - share) * np.linalg.solve(eye + gamma * x @ x, x)
        after = (after + after.T) / 2
        moved = np.linalg.norm(after - x)
        x = after
        low = min(low * (alpha + beta * square) / (1 + gamma * square), 1.0)
        if moved <= np.cbrt(_EPSILON) * size and 1 - low <= 4 * _EPSILON:
            break
    return x


def invariant_subspaces(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the eigenvectors above and below a shift; none if the matrix is a multiple of the identity.

    The median of the diagonal divides most evenly. Where it divides nothing, or an eigenvalue lies on it, the mean of
    the eigenvalues and points beside it are tried.
    """
    size = len(a)
    diagonal = np.diag(a)
    mean = float(diagonal.mean())
    spread = float(np.linalg.norm(a - mean * np.eye(size)))
    if spread <= _EPSILON * size * scale:
        return None
    rng = np.random.default_rng(size)
    best: tuple[float, np.ndarray, int] | None = None
    for shift in [float(np.median(diagonal)), mean, *(mean + spread / size * k for k in (0.01, -0.01, 0.1, -0.1))]:
        projector = (polar_factor(a - shift * np.eye(size)) + np.eye(size)) / 2
        above = round(float(np.trace(projector)))
        if not 0 < above < size:
            continue
        q, _ = np.linalg.qr(projector @ rng.standard_normal((size, above)), mode="complete")
        q, _ = np.linalg.qr(np.hstack([projector @ q[:, :above], q[:, above:] - projector @ q[:, above:]]))
        coupling = float(np.linalg.norm(q[:, above:].T @ a @ q[:, :above]))
        if best is None or coupling < best[0]:
            best = coupling, q, above
        if coupling <= 4 * _EPSILON * size * scale:
            break
    if best is None:
        return None
    return best[1][:, : best[2]], best[1][:, best[2] :]


def spectral_components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; the largest entry of each vector is positive."""
    a = (a + a.T) / 2
    scale = float(np.linalg.norm(a))
    vectors = []
    open_parts = [np.eye(len(a))]
    while open_parts:
        basis = open_parts.pop()
        if basis.shape[1] > 1:
            inner = basis.T @ a @ basis
            parts = invariant_subspaces((inner + inner.T) / 2, scale)
            if parts is not None:
                open_parts += [basis @ part for part in parts]
                continue
        vectors.append(basis)
    found = np.hstack(vectors) if vectors else np.zeros((0, 0))
    found, _ = np.linalg.qr(found)  # the bases of many divisions, made orthogonal to the last digit
    values = np.einsum("ij,ij->j", found, a @ found)
    order = np.argsort(-values, kind="stable")
    values, found = values[order], found[:, order]
    if len(found):
        found = found * np.where(found[np.abs(found).argmax(axis=0), np.arange(len(values))] < 0, -1.0, 1.0)
    return values, found


def usable_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, vector as doubles) without null vectors and those with a null or non-finite entry."""
    chosen = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    return chosen.filter("vector IS NOT NULL AND forall(vector, e -> e IS NOT NULL AND abs(e) < double('Infinity'))")


def _whole(matrix: np.ndarray) -> np.ndarray:
    """floor(SCALE * entry), without the offset, which no difference feels."""
    return np.clip(np.floor(matrix * SCALE), -LARGEST, LARGEST)


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Ids, vectors and vector lengths of bounded slices."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            column = part.column(1)
            yield part.column(0), column, np.asarray(column.value_lengths().fill_null(0))


def _matrix(column: pa.Array, lengths: np.ndarray, dimension: int) -> np.ndarray:
    rows = column.filter(pa.array(lengths == dimension))
    return np.asarray(rows.flatten(), float).reshape(len(rows), dimension)


@dataclass(frozen=True)
class Whitening:
    """What a whole table of vectors is whitened with. ``sums`` are exact and without the offset."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    @property
    def explained(self) -> list[float]:
        return [float(e) / self.trace for e in self.eigenvalues]


def _totals(rows: DataFrame) -> tuple[int, list[int]]:
    """Number and exact sums of the vectors of the commonest length, of two such the longer."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, column, lengths in _slices(batches):
            for dimension in np.unique(lengths).tolist():
                whole = _whole(_matrix(column, lengths, dimension)).astype(np.int64)
                values = [len(whole), *whole.sum(axis=0).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dimension] * len(values), pa.int32()), pa.array(range(-1, len(values) - 1), pa.int32()), pa.array(values, pa.int64())],
                    names=["dimension", "at", "value"],
                )

    parts = rows.mapInArrow(scan, "dimension int, at int, value long")
    sums = parts.groupBy("dimension", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))
    sums = sums.checkpoint()
    common = sums.filter("at = -1").orderBy(F.desc("total"), F.desc("dimension")).first()
    if common is None:
        return 0, []
    if common.dimension > MAX_DIMENSION:
        raise ValueError(f"vectors of {common.dimension} entries; at most {MAX_DIMENSION} are supported")
    found = {r.at: int(r.total) for r in sums.filter(F.col("dimension") == common.dimension).collect()}
    return found[-1], [found[i] for i in range(common.dimension)]


def _covariance(rows: DataFrame, dimension: int, n: int, centred: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """Sum of products of what ``centred`` makes of the second column, over n: a matrix for each task, summed by place."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimension, dimension))
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = centred(batch.column(1).slice(at, _ROWS))
                total += part.T @ part
        i, j = np.triu_indices(dimension)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    sums = rows.mapInArrow(scan, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((dimension, dimension))
    out[sums.i, sums.j] = out[sums.j, sums.i] = sums.v / n
    return out


def fit(vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Mean and leading components of all usable vectors: null vectors and those with a null or non-finite entry are left
    out, and so are those of another length than the commonest. Each row counts, equal ones and those without id too.

    Directions without variance, below rounding, are no components: equal rows, a single row or an empty table have none.
    """
    use_shared_folder(vectors.sparkSession)
    rows = usable_vectors(vectors, id_column, vector_column)
    n, sums = _totals(rows)
    dimension = len(sums)
    if not dimension:
        return Whitening(n, (), np.zeros(0), np.zeros((0, 0)), 0.0)
    mean = np.array([float(Fraction(s, n)) for s in sums])

    def centred(column: pa.Array) -> np.ndarray:
        return _whole(_matrix(column, np.asarray(column.value_lengths()), dimension)) - mean

    covariance = _covariance(rows, dimension, n, centred)
    values, found = spectral_components(covariance)
    trace = float(np.trace(covariance))
    kept = np.flatnonzero(values > 16 * dimension * _EPSILON * max(trace, np.finfo(float).tiny))[:components]
    return Whitening(n, tuple(sums), values[kept], found[:, kept], trace)


def exact_deviation(whole: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 for each row; none if it is beyond 64 bits."""
    largest = n * int(np.abs(whole).max(initial=0)) + max((abs(s) for s in sums), default=0)
    if largest**2 * max(len(sums), 1) < 1 << 63:
        apart = n * whole.astype(np.int64) - np.array(sums, np.int64)
        return np.einsum("ij,ij->i", apart, apart).tolist()
    totals = (sum((n * int(x) - s) ** 2 for x, s in zip(row, sums)) for row in whole.tolist())
    return [t if t < 1 << 63 else None for t in totals]


def whiten(vectors: DataFrame, model: Whitening, *, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, deviation, whitened): each usable row's distance from the mean, exact and times n, squared, and its
    coordinates, one for each component. Rows are usable as in ``fit``; a model without components gives no rows.
    A deviation beyond 64 bits is null; further columns are not read."""
    spark = vectors.sparkSession
    rows = usable_vectors(vectors, id_column, vector_column)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, deviation long, whitened array<double>"
    if not len(model.eigenvalues):
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast((model.components / np.sqrt(model.eigenvalues), model.mean))
    n, sums, dimension = model.n, model.sums, len(model.sums)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection, mean = shared.value
        for ids, column, lengths in _slices(batches):
            whole = _whole(_matrix(column, lengths, dimension))
            found = (whole - mean) @ projection
            width = found.shape[1]
            places = pa.array(np.arange(0, found.size + 1, width), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    ids.filter(pa.array(lengths == dimension)),
                    pa.array(exact_deviation(whole, n, sums), pa.int64()),
                    pa.ListArray.from_arrays(places, pa.array(found.ravel())),
                ],
                names=["vec_id", "deviation", "whitened"],
            )

    return rows.mapInArrow(scan, schema)


def identity_error(whitened: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity; their mean is 0 by construction."""
    width = len(model.eigenvalues)
    if not width:
        return 0.0

    def rows(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten(), float).reshape(len(column), width)

    covariance = _covariance(whitened.select("vec_id", "whitened"), width, model.n, rows)
    return float(np.abs(covariance - np.eye(width)).max())


def whitening_digest(whitened: DataFrame, model: Whitening) -> DataFrame:
    """One row for each vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    error = identity_error(whitened, model)
    explained = F.array(*[F.lit(e) for e in model.explained]).cast("array<double>")
    parts = whitened.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return parts.select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
