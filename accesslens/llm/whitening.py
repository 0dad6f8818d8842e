"""Whitened embeddings by spectrum slicing.

Vectors become integers (``floor(SCALE * c) + SHIFT``).  The fit list holds
each distinct integer vector once.  Its sums, and its products after taking an
integer centre off every dimension, are integers that tasks add up exactly, so
the covariance is the correctly rounded one whatever the order of the rows.

Only that matrix (dimensions squared) reaches the driver.  There

1. the inertia of ``V - s I``, read off the pivots of an LDL^T factorisation,
   counts the eigenvalues above a shift s; halving intervals by such counts
   isolates each of the leading ones;
2. Rayleigh quotient iteration, started inside the interval, converges
   cubically to the eigenpair;
3. counts on both sides of what was found certify that it has the number it
   is given.  Eigenvalues that no interval of double precision tells apart get
   an orthonormal basis.

Defined cases: rows whose vector is null, empty, or holds null or non-finite
entries take no part, nor do those with an entry beyond ``LARGEST``; of vectors
of several lengths, those of the most frequent length do (of the longer one, if
tied).  Repeated rows, and rows with null ids, are projected each; copies count
once in the fit list.  A spectrum of lower rank than ``COMPONENTS`` has fewer
components; an empty table, or one distinct vector alone, has none and gives no
rows.  Other columns are ignored.  ``deviation`` is a long: a sum of squares
that exceeds it is null rather than wrapped around, or rounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.llm.staging import staged

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Entries (after scaling) that integers and their sums hold without wrapping.
LARGEST = 1 << 40
EPS = float(np.finfo(float).eps)


def eigenvalues_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed ``shift``.

    By Sylvester's law these are the positive pivots of an LDL^T factorisation
    of ``matrix - shift * I``.  Pivots are chosen as Bunch and Parlett do: the
    largest diagonal entry, or a 2 x 2 block where that is too small beside
    the largest other entry; such a block has one positive eigenvalue.
    """
    a = matrix - shift * np.eye(len(matrix))
    tiny, above = EPS * EPS * max(1e-300, float(np.abs(a).max(initial=0))), 0
    while len(a):
        diagonal = np.abs(a.diagonal())
        k = int(diagonal.argmax())
        off = np.abs(np.triu(a, 1))
        i, j = divmod(int(off.argmax()), len(a))
        if diagonal[k] >= 0.6404 * off[i, j]:
            pivot, rows = a[k, k], [k]
            above += pivot > tiny
            if abs(pivot) <= tiny:  # nothing but zeros is left
                return above
            change = np.outer(a[:, k], a[k]) / pivot
        else:
            rows = [i, j]
            above += 1
            change = a[:, rows] @ np.linalg.solve(a[np.ix_(rows, rows)], a[rows])
        a = np.delete(np.delete(a - change, rows, 0), rows, 1)
    return above


def _interval(matrix: np.ndarray, number: int, low: float, high: float, width: float) -> tuple[float, float, int]:
    """An interval (low, high] around eigenvalue ``number`` (1 is the largest),
    and how many eigenvalues it holds: one, unless it is narrower than ``width``."""
    above_high, above_low = 0, len(matrix)
    while above_low - above_high > 1 and high - low > width:
        middle = (low + high) / 2
        above = eigenvalues_above(matrix, middle)
        if above >= number:
            low, above_low = middle, above
        else:
            high, above_high = middle, above
    return low, high, above_low - above_high


def _rayleigh(matrix: np.ndarray, start: float, found: np.ndarray, rng: np.random.Generator) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from the shift ``start``, orthogonal to the
    columns of ``found``."""
    size, scale = len(matrix), float(np.abs(matrix).max())
    vector, shift, residual = rng.standard_normal(size), start, math.inf
    for step in range(30):
        vector = vector - found @ (found.T @ vector)
        vector /= np.linalg.norm(vector)
        if step > 2:  # three inverse iterations choose the eigenvector of the interval
            shift = float(vector @ matrix @ vector)
            now = float(np.linalg.norm(matrix @ vector - shift * vector))
            if now <= 4 * EPS * scale or (step > 6 and now >= residual / 2):
                break
            residual = now
        nudge = 2 * EPS * scale
        for _ in range(8):
            try:
                solved = np.linalg.solve(matrix - shift * np.eye(size), vector)
            except np.linalg.LinAlgError:  # the shift is an eigenvalue
                solved = np.full(size, np.inf)
            if np.isfinite(solved).all() and np.linalg.norm(solved):
                break
            shift, nudge = shift + nudge, 2 * nudge
        vector = solved / np.abs(solved).max()
    vector = vector - found @ (found.T @ vector)
    vector /= np.linalg.norm(vector)
    return float(vector @ matrix @ vector), vector


def leading_eigenpairs(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues above rounding, falling, and their
    unit eigenvectors as columns."""
    size = len(matrix)
    reach = float(np.abs(matrix).sum(axis=1).max(initial=0))
    floor_, width = 16 * size * EPS * reach, 4 * EPS * reach
    wanted = min(wanted, eigenvalues_above(matrix, floor_)) if reach else 0
    values, vectors, rng = [], np.zeros((size, 0)), np.random.default_rng(12)
    while len(values) < wanted:
        number = len(values) + 1
        low, high, held = _interval(matrix, number, floor_, reach * (1 + 8 * EPS), width)
        for _ in range(12):
            # A few more halvings keep the start away from the neighbours.
            value, vector = _rayleigh(matrix, (low + high) / 2, vectors, rng)
            slack = 64 * EPS * reach
            if held > 1 or (low - slack <= value <= high + slack and eigenvalues_above(matrix, value + slack) < number <= eigenvalues_above(matrix, value - slack)):
                break
            for _ in range(4):
                middle = (low + high) / 2
                low, high = (middle, high) if eigenvalues_above(matrix, middle) >= number else (low, middle)
        else:
            raise ArithmeticError(f"eigenvalue {number} was not found where the counts place it")
        values.append(value)
        vectors = np.column_stack([vectors, vector])
    return np.array(values), vectors


@dataclass
class Whitening:
    """What the fit list gives: ``n``, sums ``S``, and the leading eigenpairs."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def centre(self) -> np.ndarray:
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    def project(self, x: np.ndarray) -> np.ndarray:
        """The whitened components of integer vectors (rows)."""
        centre = self.centre
        rest = np.array([(s - self.n * int(c)) / self.n for s, c in zip(self.sums, centre, strict=True)])
        return ((x - centre) - rest) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums over the dimensions of ``(n * x - S) ** 2``, exact; null beyond
        a long."""
        largest = max((abs(self.n * int(e) - s) for edge in (x.min(axis=0), x.max(axis=0)) for e, s in zip(edge, self.sums, strict=True)), default=0)
        if largest**2 * x.shape[1] < 1 << 63 and max(map(abs, self.sums)) < 1 << 62:
            apart = self.n * x - np.array(self.sums, np.int64)
            return pa.array((apart * apart).sum(axis=1))
        sums = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1)
        return pa.array([d if d < 1 << 63 else None for d in sums.tolist()], pa.int64())


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, x`` of the rows that take part (see the module's cases)."""
    cell = lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")) + F.lit(SHIFT)
    usable = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(SCALE * c.cast("double")) <= LARGEST)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("cells")).where((F.size("cells") > 0) & F.forall("cells", usable))
    return rows.select("vec_id", F.transform("cells", cell).cast("array<long>").alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def _added(rows: DataFrame, width: int, of) -> list[int | float]:
    """``of(matrix)``, a flat array for each batch, added up over all tasks.

    A task adds up its batches and hands on one row for each entry; Spark adds
    those of all tasks, so the driver gets as many numbers as ``of`` has."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch.column(0), width))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["entry", "value"])

    kind = "double" if of(np.zeros((1, width), np.int64)).dtype.kind == "f" else "long"
    sums = F.sum("value" if kind == "double" else F.col("value").cast("decimal(38,0)"))
    found = rows.mapInArrow(add, f"entry long, value {kind}").groupBy("entry").agg(sums.alias("value")).collect()
    return [row.value if kind == "double" else int(row.value) for row in sorted(found)]


def fit(distinct: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """The leading eigenpairs of the covariance of the rows of ``distinct``."""
    added = _added(distinct, width, lambda x: np.append(x.sum(axis=0), len(x)))
    if not added:
        return None
    *sums, n = added
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    edge = int(distinct.agg(F.max(F.array_max(F.transform("x", lambda c: F.abs(c - SHIFT))))).first()[0]) + int(np.abs(centre - SHIFT).max())
    # Products are added as integers as long as a task's sums surely fit.
    exact = edge * edge * n < 1 << 62

    def products(x: np.ndarray) -> np.ndarray:
        apart = x - centre
        return (apart.T @ apart).ravel() if exact else (apart.astype(float).T @ apart.astype(float)).ravel()

    gram = _added(distinct, width, products)
    rest = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    if exact:
        entries = [(n * g - rest[k // width] * rest[k % width]) / (n * n) for k, g in enumerate(gram)]
    else:
        entries = [g / n - rest[k // width] / n * (rest[k % width] / n) for k, g in enumerate(gram)]
    covariance = np.array(entries).reshape(width, width)
    covariance = (covariance + covariance.T) / 2
    values, vectors = leading_eigenpairs(covariance, components)
    return Whitening(n, sums, values, vectors, float(covariance.trace()))


def identity_error(distinct: DataFrame, width: int, model: Whitening) -> float:
    """How far the covariance of the whitened fit list is from the identity."""
    k = len(model.values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = model.project(x)
        return np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))

    added = np.array(_added(distinct, width, moments))
    means = added[:k] / model.n
    return float(np.abs(added[k:].reshape(k, k) / model.n - np.outer(means, means) - np.eye(k)).max())


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Each usable vector's leading whitened components, a row for each."""
    spark = vectors.sparkSession
    rows = staged(integers(vectors, id_col, vector_col).select(F.col("vec_id").cast("long").alias("vec_id"), "x"), "integers")
    lengths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if lengths is None:
        return spark.createDataFrame([], RESULT)
    width = lengths.width
    rows = rows.where(F.size("x") == width)
    distinct = staged(rows.select("x").distinct(), "fit-list")
    model = fit(distinct, width, components)
    if model is None or not len(model.values):
        return spark.createDataFrame([], RESULT)
    error = identity_error(distinct, width, model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), width)
            whitened, deviation, size = model.project(x), model.deviations(x), len(x)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(size), k)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, model.n)), deviation.take(pa.array(np.repeat(np.arange(size), k))),
                 pa.array(whitened.ravel()), pa.array(np.tile(model.values / model.trace, size)), pa.array(np.full(size * k, error))],
                [c.split()[0] for c in RESULT.split(", ")],
            )

    return rows.mapInArrow(project, RESULT)
