"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The matrix A of centred rows is never formed. A step multiplies it with a direction p and its
transpose with the product, both in one pass over the rows: each task centres its rows, takes u = Xp
and adds up Xᵀu. Since every left vector is A times a direction of the row space, it is kept as that
direction; its entries, one per row, come from the rows again when needed, so nothing that grows with
the rows is held and a lost executor only repeats its task. Both sides are orthogonalised against all
earlier vectors in each step. The singular values of the small bidiagonal matrix give the deviations
along the components, and its right vectors the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import store

SCALE = 256
COMPONENTS = 4
SEED = 20240229
#: Components whose share of the variance is below this are rounding noise.
LEAST_SHARE = 1e-13
LONG = 2**63 - 1

WHITENED = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double,"
    " identity_error double"
)


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and ``x``: floor(scale * c) + 0 of each entry c as double, kept within 64 bits.

    Rows whose vector is null, or holds null or an entry that is not finite, are dropped.
    """
    c = F.col("embedding").cast("array<double>")
    finite = ~F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    return vectors.where(F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("long"),
        # Ends of the range of doubles that fit 64 bits, so that no cast can overflow.
        F.transform(
            c,
            lambda e: F.floor(F.least(F.greatest(e * scale, F.lit(-(2.0**63))), F.lit(2.0**63 - 1024))),
        ).alias("x"),
    )


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of whole numbers as rows; shorter ones are filled with zeros."""
    lengths = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


@dataclass(frozen=True)
class Centre:
    """Number of distinct vectors and their sums by dimension, exact."""

    n: int
    sums: tuple[int, ...]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in doubles; the whole part of the mean is taken off before rounding."""
        whole = [s // self.n for s in self.sums]
        rest = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)])
        largest = max((abs(w) for w in whole), default=0)
        if largest + int(np.abs(x.astype(np.float64)).max(initial=0)) < 2**62:
            return (x - np.array(whole, dtype=np.int64)).astype(np.float64) - rest
        return x.astype(np.float64) - np.array(whole, dtype=np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x - S)^2 by row; null where it does not fit 64 bits."""
        far = self.n * int(np.abs(x.astype(np.float64)).max(initial=0))
        far += max((abs(s) for s in self.sums), default=0)
        kind = np.int64 if far * far * max(1, x.shape[1]) < 2**62 else object
        away = x.astype(kind) * self.n - np.array(self.sums, dtype=kind)
        totals = [int(t) for t in (away * away).sum(axis=1)]
        return [t if t <= LONG else None for t in totals]


def _added_up(rows: DataFrame, width: int, size: int, part: Callable) -> np.ndarray:
    """Sum over all rows of ``part`` (an array of ``size`` doubles for the rows of a batch).

    Each task adds up its batches, Spark adds up the tasks by entry.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += part(_rows(batch.column("x"), width))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["entry", "value"]
        )

    summed = rows.mapInArrow(run, "entry int, value double").groupBy("entry").agg(F.sum("value"))
    out = np.zeros(size)
    for entry, value in summed.collect():
        out[entry] = value
    return out


def centre_of(distinct: DataFrame, width: int) -> Centre:
    """Exact sums: in 64 bits as far as they reach within a batch, beyond it in whole numbers of any
    size; across tasks as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = [0] * width, 0
        for batch in batches:
            x = _rows(batch.column("x"), width)
            small = np.abs(x.astype(np.float64)).max(initial=0) * max(1, len(x)) < 2**62
            for i, s in enumerate((x if small else x.astype(object)).sum(axis=0)):
                sums[i] += int(s)
            n += len(x)
        # The last entry is the number of rows.
        values = pa.array([*map(str, sums), str(n)], pa.string())
        entries = pa.array(np.arange(width + 1, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([entries, values], ["entry", "value"])

    value = F.sum(F.col("value").cast("decimal(38,0)")).cast("string")
    summed = distinct.mapInArrow(run, "entry int, value string").groupBy("entry").agg(value)
    found = {entry: int(total) for entry, total in summed.collect()}
    return Centre(found.get(width, 0), tuple(found.get(i, 0) for i in range(width)))


# --- bidiagonalisation -----------------------------------------------------------------------


def _off(basis: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """``vector`` without its part along the orthonormal columns of ``basis``."""
    for _ in range(2):
        vector = vector - basis @ (basis.T @ vector)
    return vector


def bidiagonalise(
    gram: Callable[[np.ndarray], np.ndarray], width: int, total: float, count: int
) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest singular values of A, and its right singular vectors as columns.

    ``gram(p)`` is Aᵀ(Ap), by a pass over the rows; ``total`` the sum of squares of A. A step takes
    the next right vector v, makes u from Av and v' from Aᵀu, each orthogonal to all before, and adds
    a column to the bidiagonal matrix. If nothing is left of v', the space found so far is closed
    under A, and a new direction outside it is drawn; so values that occur several times are found
    several times. It ends when the directions span the whole row space, or before that once the
    wanted vectors are as exact as doubles allow and no direction outside can hold a larger value.
    """
    rng = np.random.Generator(np.random.PCG64(SEED))
    right = np.zeros((width, 0))  # v, orthonormal
    lefts = np.zeros((width, 0))  # u = A times these columns
    images = np.zeros((width, 0))  # Aᵀu
    diagonal, above = [], []
    following, coupling = None, 0.0
    while right.shape[1] < width:
        if following is None:
            following, coupling = _off(right, rng.standard_normal(width)), 0.0
            following /= np.linalg.norm(following)
        v = following
        if diagonal:
            above.append(coupling)
        right = np.column_stack((right, v))
        p, z = v, gram(v)
        for _ in range(2):  # u without its part along the earlier ones: uᵀ(Ap) = pᵢᵀ(AᵀAp)
            along = lefts.T @ z
            p, z = p - lefts @ along, z - images @ along
        length = float(np.sqrt(max(p @ z, 0.0)))
        known = length > 1e-12 * np.sqrt(total)
        p, z = (p / length, z / length) if known else (np.zeros(width), np.zeros(width))
        lefts, images = np.column_stack((lefts, p)), np.column_stack((images, z))
        diagonal.append(length if known else 0.0)
        following = _off(right, z)
        coupling = float(np.linalg.norm(following))
        if coupling > 1e-13 * np.sqrt(total):
            following = following / coupling
        else:
            following, coupling = None, 0.0
        if len(diagonal) >= count and _settled(diagonal, above, coupling, total, count):
            break
    _, values, vectors = np.linalg.svd(_upper(diagonal, above))
    return values[:count], (right @ vectors.T)[:, :count]


def _upper(diagonal: list[float], above: list[float]) -> np.ndarray:
    return np.diag(diagonal) + np.diag(above, 1)


def _settled(
    diagonal: list[float], above: list[float], coupling: float, total: float, count: int
) -> bool:
    """Whether the ``count`` largest values and their vectors can change no more."""
    _, values, vectors = np.linalg.svd(_upper(diagonal, above))
    squares, link = values**2, diagonal[-1] * coupling
    if (link * np.abs(vectors[:count, -1]) > 1e-15 * squares[0]).any():
        return False
    # Squares left outside, and the largest value that they and the rest can form together.
    outside = max(total - float(squares.sum()), 0.0) + 1e-14 * total
    inside = float(squares[count]) if len(squares) > count else 0.0
    bound = (inside + outside) / 2 + np.hypot((inside - outside) / 2, link)
    return bound < squares[count - 1]


# --- operators -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """A fitted transformation: components as columns, by falling eigenvalue of the covariance."""

    width: int
    centre: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The components of the distinct vectors in ``rows`` (column ``x``), each counted once.

    The covariance has the divisor n. Components are orthonormal; the largest entry of each is
    positive. There are fewer than asked if the rest has no variance, and None if there are no rows.
    """
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if width is None:
        return None
    x = F.col("x")
    filled = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(x)))
    distinct = store(rows.select(filled.alias("x")).distinct(), "whitening-distinct")
    centre = centre_of(distinct, width)

    def gram(p: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            away = centre.centred(x)
            return away.T @ (away @ p)

        return _added_up(distinct, width, width, part)

    total = float(
        _added_up(distinct, width, 1, lambda x: np.array([np.square(centre.centred(x)).sum()]))[0]
    )
    wanted = min(components, width)
    if total > 0:
        values, vectors = bidiagonalise(gram, width, total, wanted)
    else:
        values, vectors = np.zeros(0), np.zeros((width, 0))
    kept = values**2 > LEAST_SHARE * total
    values, vectors = values[kept], vectors[:, kept]
    top = np.abs(vectors).argmax(axis=0) if vectors.size else np.zeros(0, dtype=int)
    vectors = vectors * np.sign(vectors[top, np.arange(len(values))])
    eigenvalues = values**2 / centre.n
    m = len(values)

    def covariance(x: np.ndarray) -> np.ndarray:
        projected = centre.centred(x) @ vectors / np.sqrt(eigenvalues)
        return (projected.T @ projected).reshape(-1)

    error = 0.0
    if m:
        found = _added_up(distinct, width, m * m, covariance).reshape(m, m) / centre.n
        error = float(np.abs(found - np.eye(m)).max())
    share = values**2 / total if m else np.zeros(0)
    return Whitening(width, centre, vectors, eigenvalues, share, error)


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """The columns of ``WHITENED``: a row for each row (vec_id, x) and component."""
    m = len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column("x"), model.width)
            whitened = model.centre.centred(x) @ model.components / np.sqrt(model.eigenvalues)
            each = np.repeat(np.arange(len(x)), m)
            size = len(each)
            columns = [
                batch.column("vec_id").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                pa.array(np.full(size, model.centre.n, dtype=np.int64)),
                pa.array(model.centre.deviations(x), pa.int64()).take(pa.array(each)),
                pa.array(whitened.reshape(-1)),
                pa.array(np.tile(model.explained, len(x))),
                pa.array(np.full(size, model.identity_error)),
            ]
            names = [field.split()[0] for field in WHITENED.split(", ")]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, WHITENED)


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """The columns of ``WHITENED`` for each usable row of ``vectors`` (vec_id, embedding).

    ``deviation`` is exact, and null where it does not fit 64 bits; ``identity_error`` is the largest
    entry of the whitened covariance minus the identity. Rows that repeat a vector, or a vec_id, have
    rows of their own but a vector is counted once in the fit; a null vec_id stays. Vectors shorter
    than the longest are filled with zeros. Entries beyond 64 bits after scaling count as the ends of
    that range. Without rows, or if all vectors are the same, there is no component and no row.
    """
    rows = store(quantized(vectors, scale), "whitening-rows")
    model = fit(rows, components)
    if model is None or not len(model.eigenvalues):
        return vectors.sparkSession.createDataFrame([], WHITENED)
    return transform(rows, model)
