"""Whitening of embeddings by the leading components of their covariance, found by slicing its spectrum."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
LARGEST = 2.0**52  # of a scaled entry; beyond, it has no exact integer and counts as not finite
SMALL = 2**26  # integers whose squares' sums stay exact in 64 bits
RANK_TOLERANCE = 1e-12  # of the trace: components with less variance cannot be scaled to one
PIVOT = (1 + 17**0.5) / 8  # bound of element growth in the factorisation


def eigenvalues_above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie above ``shift``.

    By Sylvester's law of inertia these are the positive pivots of an LDLᵀ
    factorisation of ``v - shift I``. Pivots are chosen as by Bunch and Kaufman;
    a pivot of two rows is indefinite and has one positive eigenvalue.
    """
    m = v - shift * np.eye(len(v))
    above = 0
    while len(m):
        below = np.abs(m[1:, 0])
        top = below.max(initial=0.0)
        if top == 0.0:
            above += bool(m[0, 0] > 0)
            m = m[1:, 1:]
            continue
        r, single = int(below.argmax()) + 1, True
        if abs(m[0, 0]) < PIVOT * top:
            beside = np.abs(m[:, r])
            beside[r] = 0.0
            side = beside.max()
            if abs(m[0, 0]) * side < PIVOT * top * top:
                single = bool(abs(m[r, r]) >= PIVOT * side)
                order = np.arange(len(m))
                swapped = 0 if single else 1
                order[[swapped, r]] = order[[r, swapped]]
                m = m[np.ix_(order, order)]
        if single:
            above += bool(m[0, 0] > 0)
            m = m[1:, 1:] - np.outer(m[1:, 0], m[1:, 0] / m[0, 0])
        else:
            above += 1
            m = m[2:, 2:] - m[2:, :2] @ np.linalg.solve(m[:2, :2], m[:2, 2:])
    return above


def _rayleigh(v: np.ndarray, shift: float, known: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray, float]:
    """``(value, unit vector, residual)`` by two inverse iterations at ``shift`` and then Rayleigh quotient iteration.

    Vectors stay orthogonal to the columns of ``known``.
    """
    unit, eps = np.eye(len(v)), np.finfo(float).eps * np.abs(v).sum(axis=1).max()
    best = (shift, start, np.inf)
    x, value = start, shift
    for step in range(30):
        try:
            x = np.linalg.solve(v - value * unit, x)
        except np.linalg.LinAlgError:
            x = np.linalg.solve(v - (value + eps) * unit, x)
        for _ in range(2):
            x = x - known @ (known.T @ x)
        x = x / np.linalg.norm(x)
        quotient = float(x @ v @ x)
        residual = float(np.linalg.norm(v @ x - quotient * x))
        if residual < best[2]:
            best = (quotient, x, residual)
        elif step > 3:
            break
        if step:
            value = quotient
    return best


def leading_components(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """``(eigenvalues, eigenvectors as columns)``: the ``most`` largest of a covariance matrix, by falling value.

    The k-th eigenvalue is shut in by counts: at least k eigenvalues lie above the
    lower end, fewer than k above the upper. The interval is halved until it holds
    that one alone, or is as narrow as rounding lets equal ones be. Rayleigh
    quotient iteration from inside then converges cubically, and counts on both
    sides of the result certify that it is the k-th; if not, the interval is
    halved on. Components below ``RANK_TOLERANCE`` of the trace are left out.
    """
    trace, size = float(np.trace(v)), len(v)
    values, vectors = [], np.zeros((size, 0))
    if not trace > 0:
        return np.array(values), vectors
    high = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-9)
    floor = RANK_TOLERANCE * trace
    counted = {floor: eigenvalues_above(v, floor), high: 0}
    narrow = 64 * np.finfo(float).eps * high

    def above(shift: float) -> int:
        if shift not in counted:
            counted[shift] = eigenvalues_above(v, shift)
        return counted[shift]

    draws = np.random.default_rng(11)
    for k in range(1, min(most, counted[floor]) + 1):
        low = max(s for s, n in counted.items() if n >= k)
        top = min(s for s, n in counted.items() if n < k)
        while True:
            middle = (low + top) / 2
            if (above(low) == k and above(top) == k - 1) or top - low <= narrow:
                value, vector, residual = _rayleigh(v, middle, vectors, draws.standard_normal(size))
                slack = 2 * residual + narrow
                if eigenvalues_above(v, value - slack) >= k > eigenvalues_above(v, value + slack):
                    break
                if top - low <= narrow / 64:
                    raise ArithmeticError(f"no eigenvalue could be certified as number {k}")
            low, top = (middle, top) if above(middle) >= k else (low, middle)
        values.append(value)
        vectors = np.concatenate([vectors, vector[:, None]], axis=1)
    return np.array(values), vectors


@dataclass
class Whitening:
    """Rows and per-dimension sums of the integer vectors, their covariance's trace, and its leading components."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def centre(self) -> np.ndarray:
        """The integer at or below each dimension's mean; what is left of the mean is in ``rest``."""
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> list[int]:
        """``sums - n * centre``: below n, so that means of large integers keep all their digits."""
        return [s % self.n for s in self.sums]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x`` less its mean, as doubles."""
        return (x - self.centre).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact ``sum((n * x - sums) ** 2)`` of each row."""
        y, rest = x - self.centre, self.rest
        if np.abs(y).max(initial=0) * max([1, *rest]) * max(x.shape[1], 1) >= 2**62 or np.abs(y).max(initial=0) >= SMALL:
            y = y.astype(object)
        squares, mixed = (y * y).sum(axis=1).tolist(), (y * np.array(rest, dtype=y.dtype)).sum(axis=1).tolist()
        last = sum(r * r for r in rest)
        return [self.n * self.n * int(a) - 2 * self.n * int(b) + last for a, b in zip(squares, mixed)]


def integer_vectors(df: DataFrame, vector_col: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """The rows that take part, with ``__x``: ``floor(scale * entry) + offset`` of each entry."""
    v = F.col(f"`{vector_col}`")
    scaled = F.transform(v, lambda e: e.cast("double") * F.lit(float(scale)))
    finite = F.forall(scaled, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < LARGEST))
    return df.where(v.isNotNull() & finite).withColumn("__x", F.transform(scaled, lambda e: F.floor(e).cast("long") + offset))


def _matrix(lists: pa.ListArray, dim: int | None = None, filled: int = OFFSET) -> np.ndarray:
    """One row per list; shorter ones are filled up as by entries of zero."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    dim = int(sizes.max(initial=0)) if dim is None else dim
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.full((len(sizes), dim), filled, dtype=np.int64)
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


def _summed(vectors: DataFrame, partial, schema: str = "i int, j int, total double") -> list:
    """Sums of what ``partial`` gives for each batch, a square array of fixed size for every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = partial(batch.column(0))
                total = found if total is None else total + found
        if total is not None:
            i, j = np.indices(total.shape).reshape(2, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "total"])

    return vectors.select("__x").mapInArrow(run, schema).groupBy("i", "j").agg(F.sum("total").alias("total")).collect()


def _square(rows: list, size: tuple[int, int]) -> np.ndarray:
    out = np.zeros(size)
    for r in rows:
        out[r["i"], r["j"]] = r["total"]
    return out


def fit_whitening(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> Whitening:
    """The model from all vectors that take part.

    Two passes, each with sums of one array a task: exact integer sums and the
    row count, then products of the centred rows. What reaches the driver has the
    size of the covariance matrix, whose eigenvalues are found there.
    """
    vectors = integer_vectors(df, vector_col, scale, offset)
    longest = vectors.agg(F.max(F.size("__x"))).first()[0]
    if longest is None:
        return Whitening(0, [], 0.0, np.zeros(0), np.zeros((0, 0)))

    def sums(lists: pa.ListArray) -> np.ndarray:
        m = _matrix(lists, longest, offset)
        return np.concatenate([[len(m)], m.sum(axis=0)]).astype(np.int64)[None, :]

    found = {r["j"]: int(r["total"]) for r in _summed(vectors, sums, "i int, j int, total long")}
    n = found.pop(0)
    model = Whitening(n, [found[j + 1] for j in range(longest)], 0.0, np.zeros(0), np.zeros((longest, 0)))

    def products(lists: pa.ListArray) -> np.ndarray:
        y = model.centred(_matrix(lists, longest, offset))
        return y.T @ y

    v = _square(_summed(vectors, products), (longest, longest)) / n
    v = (v + v.T) / 2
    model.trace = float(np.trace(v))
    model.values, model.vectors = leading_components(v, components)
    return model


def identity_error(df: DataFrame, model: Whitening, vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity; 0 without components."""
    k = len(model.values)
    if not k:
        return 0.0

    def products(lists: pa.ListArray) -> np.ndarray:
        z = model.whitened(_matrix(lists, len(model.sums), offset))
        z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
        return z.T @ z

    found = _square(_summed(integer_vectors(df, vector_col, scale, offset), products), (k + 1, k + 1)) / model.n
    mean = found[:k, k]
    return float(np.abs(found[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, model: Whitening, vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """The rows of ``df`` that take part, with ``whitened`` and ``deviation``.

    Vectors that are null or hold null or non-finite entries (or entries of more
    than 52 bits after scaling) are dropped; shorter ones count as filled up with
    zeros. ``whitened`` holds the row's place along each component in units of
    its standard deviation. ``deviation decimal(38,0)`` is the exact
    ``sum((n * x - sums) ** 2)``, null beyond 38 digits. Rows that repeat are
    each a row; input columns of these names are replaced. Where all vectors are
    equal there is no component, and ``whitened`` is empty.
    """
    others = [c for c in df.columns if c not in ("whitened", "deviation")]
    rows = integer_vectors(df, vector_col, scale, offset).select(*[f"`{c}`" for c in others], "__x")
    schema = T.StructType(
        [
            *[f for f in rows.schema.fields if f.name != "__x"],
            T.StructField("whitened", T.ArrayType(T.DoubleType())),
            T.StructField("deviation", T.DecimalType(38, 0)),
        ]
    )
    dim, k = len(model.sums), len(model.values)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(len(others)), dim, offset)
            z = model.whitened(x) if k else np.zeros((len(x), 0))
            ends = (np.arange(len(x) + 1) * k).astype(np.int32)
            exact = [Decimal(d) if d < 10**38 else None for d in model.deviations(x)] if model.n else []
            columns = [*batch.columns[: len(others)], pa.ListArray.from_arrays(ends, pa.array(z.ravel())), pa.array(exact, pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(projected, schema)
