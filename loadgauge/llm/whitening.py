"""Whitening of embeddings by the leading components of their exact covariance.

Vectors become whole numbers, so sums and products over any number of rows are exact whatever
the order they are added in.  The covariance of d dimensions (d rows and columns) is all that the
driver sees.  There its leading eigenvalues are found by spectrum slicing: the inertia of
V - s*I, read off an LDL' factorisation, says how many eigenvalues exceed s.  Bisection on
these counts isolates each eigenvalue; Rayleigh quotient iteration sharpens it; counts on both sides
of the result certify that it is the one with its number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadgauge.llm.common import free_name
from loadgauge.plans.joining import settle

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
_EPS = np.finfo(float).eps
_EXACT = 1 << 53  # whole doubles up to here add up exactly
_LARGEST = 1 << 46  # of an entry times SCALE: sums of squares of 1e9 rows still fit decimal(38, 0)


# The eigenvalues of one small matrix.


def inertia(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed ``shift``.

    By Sylvester's law, the number of positive ones in D of the factorisation LDL' of
    matrix - shift*I.  D has blocks of one and two, chosen by complete pivoting (Bunch and
    Parlett), which keeps its entries small; a block of two has one eigenvalue of either sign.
    """
    a = matrix - shift * np.eye(len(matrix))
    ratio, positive = (1 + math.sqrt(17)) / 8, 0
    while len(a):
        diagonal = np.abs(np.diagonal(a))
        p = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diagonal(a)))
        q, r = np.unravel_index(int(off.argmax()), a.shape)
        if diagonal[p] == 0 and off[q, r] == 0:
            break  # what is left is zero: no eigenvalue above the shift
        if diagonal[p] >= ratio * off[q, r]:
            positive += a[p, p] > 0
            rest = np.delete(np.arange(len(a)), p)
            column = a[rest, p]
            a = a[np.ix_(rest, rest)] - np.outer(column, column) / a[p, p]
        else:
            positive += 1
            rest = np.delete(np.arange(len(a)), [q, r])
            block, sides = a[np.ix_([q, r], [q, r])], a[np.ix_(rest, [q, r])]
            a = a[np.ix_(rest, rest)] - sides @ np.linalg.solve(block, sides.T)
        a = (a + a.T) / 2
    return int(positive)


def _bisect(matrix: np.ndarray, k: int, low: float, high: float, tiny: float) -> tuple[float, float]:
    """The interval around the k-th largest eigenvalue, halved until no other lies in it or it is tiny."""
    n_low, n_high = inertia(matrix, low), inertia(matrix, high)
    while high - low > tiny and not (n_low == k and n_high == k - 1):
        middle = (low + high) / 2
        n = inertia(matrix, middle)
        if n >= k:
            low, n_low = middle, n
        else:
            high, n_high = middle, n
    return low, high


def _orthogonal(vector: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in others:
            vector = vector - (other @ vector) * other
    return vector / np.linalg.norm(vector)


def _solve(matrix: np.ndarray, shift: float, vector: np.ndarray, norm: float) -> np.ndarray:
    """(matrix - shift*I)^-1 vector, with the shift moved off an eigenvalue that it hits."""
    step = 0.0
    while True:
        try:
            found = np.linalg.solve(matrix - (shift + step) * np.eye(len(matrix)), vector)
            if np.isfinite(found).all() and found.any():
                return found / np.abs(found).max()
        except np.linalg.LinAlgError:
            pass
        step = 2 * step or _EPS * norm


def leading_pairs(matrix: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of the ``most`` largest eigenvalues of a
    positive semidefinite matrix; those that rounding cannot tell from zero are left out.

    Of several equal eigenvalues the vectors are orthogonal, but otherwise any.  The largest entry of
    a vector is positive (the first of several).  A pair that the counts do not certify raises.
    """
    dim = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max()) if dim else 0.0
    tiny = 4 * _EPS * norm
    values: list[float] = []
    vectors: list[np.ndarray] = []
    high = norm + tiny
    for k in range(1, min(most, dim) + 1):
        if norm == 0 or inertia(matrix, dim * tiny) < k:
            break
        low, top = _bisect(matrix, k, 0.0, high, tiny)
        for start in range(dim):
            # A fixed start, made orthogonal to what was found; equal eigenvalues need that.
            begin = np.cos(np.arange(dim) * (1.0 + start) + k)
            vector = _orthogonal(begin, vectors)
            shift = (low + top) / 2
            for _ in range(2):
                vector = _orthogonal(_solve(matrix, shift, vector, norm), vectors)
            value = float(vector @ matrix @ vector)
            for _ in range(40):
                residual = float(np.linalg.norm(matrix @ vector - value * vector))
                if residual <= tiny * 4:
                    break
                # Rayleigh quotients converge cubically, but may leave the interval: then halve it.
                if low <= value <= top:
                    shift = value
                else:
                    middle = (low + top) / 2
                    if top - low > tiny:
                        low, top = (middle, top) if inertia(matrix, middle) >= k else (low, middle)
                    shift = (low + top) / 2
                vector = _orthogonal(_solve(matrix, shift, vector, norm), vectors)
                value = float(vector @ matrix @ vector)
            margin = float(np.linalg.norm(matrix @ vector - value * vector)) + 4 * tiny
            if margin <= 1e-9 * norm and inertia(matrix, value + margin) < k <= inertia(matrix, value - margin):
                break
        else:
            raise ArithmeticError(f"eigenvalue {k} is not certified")
        values.append(value)
        vectors.append(vector if vector[np.abs(vector).argmax()] > 0 else -vector)
        # The next one lies below, or is one of several equal ones.
        high = value + margin + tiny
    return np.array(values), np.array(vectors).T.reshape(dim, len(values))


# Exact sums over all rows.


def exact_gram(rows: np.ndarray) -> np.ndarray:
    """rows' rows of whole numbers (int64), as Python integers.

    Halves of 23 bits keep every product and every partial sum a whole double below 2^53.
    """
    if not len(rows):
        return np.zeros((rows.shape[1],) * 2, object)
    total = np.zeros((rows.shape[1],) * 2, object)
    if np.abs(rows).max() < 1 << 23:
        parts = [(0, rows)]
    else:
        high = rows >> 23
        parts = [(0, rows - (high << 23)), (23, high)]
    for bits, a in parts:
        for other, b in parts:
            top = max(1, int(np.abs(a).max())) * max(1, int(np.abs(b).max()))
            step = max(1, _EXACT // top)
            for i in range(0, len(rows), step):
                product = a[i : i + step].astype(float).T @ b[i : i + step].astype(float)
                total = total + (product.astype(np.int64).astype(object) << (bits + other))
    return total


@dataclass(frozen=True)
class Fit:
    """What the fit list says: its number, sums, eigenvalues, components and total variance."""

    n: int
    sums: tuple[int, ...]
    centre: np.ndarray  # whole numbers next to the means
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def rest(self) -> np.ndarray:
        """sums - n * centre, as Python integers."""
        return np.array([s - self.n * int(c) for s, c in zip(self.sums, self.centre, strict=True)], object)


def whole_vectors(rows: DataFrame, vec_col: str, scale: int = SCALE, shift: int = SHIFT) -> tuple[DataFrame, int]:
    """(rows with vec_col as the bytes of whole numbers, their dimension), settled.

    A vector that is null, empty, or holds a null or non-finite entry or one beyond 2^46 / scale is
    left out, as is one of another length than most (of equally many, the smaller length).
    """
    others = [c for c in rows.columns if c != vec_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            column = batch.column(batch.num_columns - 1)
            for i in range(len(column)):
                value = column[i].values
                found = None
                if value is not None and len(value) and not value.null_count:
                    raw = np.floor(scale * value.to_numpy(zero_copy_only=False).astype(float))
                    if np.isfinite(raw).all() and np.abs(raw).max() <= _LARGEST:
                        found = (raw.astype(np.int64) + shift).astype("<i8").tobytes()
                out.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], [*others, vec_col])

    asked = rows.select(*others, F.col(vec_col).cast("array<double>").alias(vec_col))
    schema = rows.select(*others).schema.add(vec_col, "binary")
    found = settle(asked.mapInArrow(run, schema).filter(F.col(vec_col).isNotNull()))
    sizes = found.groupBy(F.octet_length(vec_col).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    size = sizes[0].n if sizes else 0
    return found.filter(F.octet_length(vec_col) == size), size // 8


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), dim)


def fit(vectors: DataFrame, vec_col: str, dim: int, most: int = COMPONENTS) -> Fit:
    """Two passes: number and sums, then products of what is left of the centre.

    Each task adds up its rows and sends d*(d+1)/2 whole numbers, which Spark adds up as decimals;
    so the driver gets one covariance, whatever the number of rows and tasks.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, object)
        for batch in batches:
            rows = _matrix(batch.column(0), dim)
            n += len(rows)
            # Sums of halves of the bits cannot pass 64 bits.
            total = total + (rows >> 24).sum(axis=0).astype(object) * (1 << 24) + (rows & ((1 << 24) - 1)).sum(axis=0).astype(object)
        places = [-1, *range(dim)]
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array([str(x) for x in [n, *total]], pa.string())], ["i", "s"])

    whole = F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
    sums = {r.i: int(r.s) for r in vectors.select(vec_col).mapInArrow(add, "i int, s string").groupBy("i").agg(whole).collect()}
    n = sums.get(-1, 0)
    if not n:
        return Fit(0, (), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0)
    total = tuple(sums[i] for i in range(dim))
    centre = np.array([round(Fraction(s, n)) for s in total], np.int64)
    upper = np.triu_indices(dim)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((dim, dim), object)
        for batch in batches:
            gram = gram + exact_gram(_matrix(batch.column(0), dim) - centre)
        columns = [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array([str(x) for x in gram[upper]], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "s"])

    products = vectors.select(vec_col).mapInArrow(multiply, "i int, j int, s string").groupBy("i", "j").agg(whole).collect()
    rest = [s - n * int(c) for s, c in zip(total, centre, strict=True)]
    covariance = np.zeros((dim, dim))
    for r in products:
        # Exact, rounded once.
        covariance[r.i, r.j] = covariance[r.j, r.i] = float(Fraction(n * int(r.s) - rest[r.i] * rest[r.j], n * n))
    values, components = leading_pairs(covariance, most)
    return Fit(n, total, centre, values, components, float(np.trace(covariance)))


def whiten(rows: DataFrame, vec_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: the other columns, component (from 1), n, deviation, whitened,
    explained, identity_error.

    x = floor(1024 * c) + 100000 for every entry c.  deviation is the exact sum over dimensions of
    (n * x - S)^2 as decimal(38, 0) (null if it passes that); whitened the centred vector on the
    component over the root of its eigenvalue; explained the eigenvalue's share of the variance;
    identity_error, the same in every row, the largest entry of whitened's covariance minus the
    identity, measured on all rows.

    Rows count one by one, with or without id, repeated or not.  ``whole_vectors`` says which vectors
    take no part.  Components without variance have no rows: none at all for one vector or equal ones,
    fewer than ``most`` for fewer dimensions.  An empty table gives no rows.  Other columns stay; those
    called like a result give way to it.
    """
    results = {"component", "n", "deviation", "whitened", "explained", "identity_error"}
    kept = [c for c in rows.columns if c != vec_col and c.lower() not in results]
    vectors, dim = whole_vectors(rows.select(*kept, vec_col), vec_col)
    model = fit(vectors, vec_col, dim, most)
    count = len(model.values)
    spread = free_name(rows, "__whitened")
    n, rest, centre = model.n, model.rest, model.centre
    rest_float = np.array([float(Fraction(int(x), n)) for x in rest]) if n else np.zeros(0)
    onto = model.components / np.sqrt(model.values) if count else np.zeros((dim, 0))
    rest_squared = int((rest * rest).sum()) if n else 0

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _matrix(batch.column(batch.num_columns - 1), dim) - centre
            if len(y) and int(np.abs(y).max()) ** 2 * dim >= 1 << 62:
                exact = y.astype(object)
                squares, mixed = (exact * exact).sum(axis=1), exact @ rest
            else:
                squares = (y * y).sum(axis=1).astype(object)
                top = max(map(abs, rest.tolist()), default=0) * (int(np.abs(y).max()) if len(y) else 0) * dim
                mixed = (y @ rest.astype(np.int64)).astype(object) if top < 1 << 62 else y.astype(object) @ rest
            # Sum of (n*y - rest)^2, in Python integers.
            deviation = [n * n * int(a) - 2 * n * int(b) + rest_squared for a, b in zip(squares, mixed, strict=True)]
            white = (y - rest_float) @ onto
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * count), pa.array(white.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([str(d) for d in deviation], pa.string()), lists], [*kept, "deviation", spread]
            )

    schema = rows.select(*kept).schema.add("deviation", "string").add(spread, T.ArrayType(T.DoubleType()))
    white = settle(vectors.mapInArrow(project, schema))
    error = _identity_error(white, spread, count)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values]) if count else F.array().cast("array<double>")
    place = free_name(rows, "__place")
    long_rows = white.withColumn("deviation", F.expr("try_cast(deviation AS decimal(38,0))")).select(
        *kept, "deviation", F.posexplode(spread).alias(place, "whitened")
    )
    return long_rows.select(
        *kept, (F.col(place) + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col(place)).alias("explained"), F.lit(error).alias("identity_error"),
    )


def _identity_error(white: DataFrame, spread: str, count: int) -> float:
    """Largest absolute entry of the covariance of all whitened rows minus the identity."""
    if not count:
        return 0.0
    entry = [F.get(F.col(spread), F.lit(i)) for i in range(count)]
    means = white.agg(*[F.avg(e).alias(str(i)) for i, e in enumerate(entry)]).collect()[0]
    centred = [e - F.lit(means[i]) for i, e in enumerate(entry)]
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    products = white.agg(*[F.avg(centred[i] * centred[j]).alias(f"{i}_{j}") for i, j in pairs]).collect()[0]
    return max(abs(products[k] - (i == j)) for k, (i, j) in enumerate(pairs))
