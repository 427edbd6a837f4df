"""Whitening of embeddings along principal components found by spectral divide and conquer.

Vectors become integers (floor of `scale` times each entry), so counts and sums are exact. Every distinct integer vector
counts once. The covariance is summed on Spark from centred rows, task by task, cell by cell; only its d x d cells reach the driver.
There the matrix is split again and again: the polar factor of the covariance less a shift, from dynamically weighted
Halley steps (QDWH), is its matrix sign, which gives the projectors on the components above and below the shift; each
invariant subspace is split in turn until it has one dimension. The few components asked for are broadcast and every row
is projected.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.scratch import Scratch

WIDEST = 4096  # dimensions: the driver holds a few matrices of this many rows and columns
BLOCK = 4096  # vectors multiplied at once
LARGEST = 2.0 ** 62  # scaled entries at least this large do not fit


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix by QDWH; its matrix sign where no eigenvalue is zero."""
    n, eps = len(a), np.finfo(float).eps
    size = np.linalg.norm(a)
    if size == 0:
        return np.eye(n)
    x, low = a / size, eps / 4  # a safe lower bound of the least singular value; smaller ones count as zero
    for _ in range(30):
        # Weights of the Halley step that maps [low, 1] closest to 1.
        square = low * low
        root = np.cbrt(4 * (1 - square) / (square * square))
        first = np.sqrt(1 + root)
        weight = first + np.sqrt(8 - 4 * root + 8 * (2 - square) / (square * first)) / 2
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))
        new = b / c * x + (weight - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(low * (weight + b * square) / (1 + c * square), 1.0)
        if abs(1 - low) < 10 * eps and moved < np.cbrt(eps):
            break
    return x


def split(a: np.ndarray, shift: float) -> tuple[np.ndarray, int]:
    """An orthonormal basis whose first k columns span the eigenspace of `a` above `shift`, and k."""
    n = len(a)
    above = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = int(round(np.trace(above)))
    if not 0 < k < n:
        return np.eye(n), k
    # Two rounds of subspace iteration with the projector; the columns behind the k-th span the other eigenspace.
    start = np.random.default_rng(n).standard_normal((n, k))
    q, _ = np.linalg.qr(above @ start)
    q, _ = np.linalg.qr(above @ q)
    return np.linalg.qr(q, mode="complete")[0], k


def divide(a: np.ndarray, floor: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) of a symmetric matrix, by falling eigenvalue."""
    n = len(a)
    a = (a + a.T) / 2
    if floor is None:
        floor = np.finfo(float).eps * np.linalg.norm(a)
    middle = np.trace(a) / max(n, 1)
    if n <= 1 or np.linalg.norm(a - middle * np.eye(n)) <= floor:  # a multiple of the identity: any basis will do
        return np.diag(a).copy(), np.eye(n)
    half = np.linalg.norm(np.diag(a) - np.median(np.diag(a)))
    for shift in (np.median(np.diag(a)), middle, middle + half / n, middle - half / n, *np.linspace(np.diag(a).min(), np.diag(a).max(), 5)):
        q, k = split(a, shift)
        if 0 < k < n:
            turned = q.T @ a @ q
            if np.linalg.norm(turned[:k, k:]) <= 50 * n * floor:
                break
    else:  # every shift hits an eigenvalue or none separates: step between the bounds that Gershgorin's circles give
        return by_bisection(a, floor)
    parts = [divide(turned[:k, :k], floor), divide(turned[k:, k:], floor)]
    values = np.concatenate([v for v, _ in parts])
    vectors = np.hstack([q[:, :k] @ parts[0][1], q[:, k:] @ parts[1][1]])
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def by_bisection(a: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Halve the range of eigenvalues until a shift separates some, or they are all alike."""
    n, radius = len(a), np.abs(a).sum(1)
    low, high = float((2 * np.diag(a) - radius).min()), float(radius.max())
    while high - low > floor:
        shift = (low + high) / 2 + (high - low) * 1e-3  # off centre, to miss symmetric spectra
        q, k = split(a, shift)
        if 0 < k < n:
            turned = q.T @ a @ q
            parts = [divide(turned[:k, :k], floor), divide(turned[k:, k:], floor)]
            return np.concatenate([parts[0][0], parts[1][0]]), np.hstack([q[:, :k] @ parts[0][1], q[:, k:] @ parts[1][1]])
        low, high = (shift, high) if k == n else (low, shift)
    return np.diag(a).copy(), np.eye(n)


class Whitening(NamedTuple):
    """What was learned from the distinct vectors: their number, sums by dimension, covariance, components."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray  # eigenvalues, falling; none that is zero to double precision
    vectors: np.ndarray  # unit eigenvectors, one column each
    identity_error: float  # largest entry of the whitened vectors' covariance less the identity


def to_integers(vectors: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Rows whose vector is whole, with `x`, floor(scale * entry) as longs; `vector` is dropped.

    Rows go whose vector is null or empty, or holds null, NaN, infinite entries or such that do not fit a long. If vectors
    differ in length, those of the commonest length stay (of the longer, in a tie).
    """
    scaled = vectors.withColumn("x", F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * scale))).where(
        F.forall(F.col(vector).cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < LARGEST)) & (F.size(vector) > 0))
    lengths = scaled.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    if d > WIDEST:
        raise ValueError(f"vectors of more than {WIDEST} entries")
    return scaled.where(F.size("x") == d).drop(vector)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A column of equally long lists as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def cell_sums(rows: DataFrame, d: int, size: int, of_block) -> np.ndarray:
    """The sum over all rows of `of_block(integer matrix)`, an array of `size` cells, added up by cell on Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for i in range(0, len(batch), BLOCK):
                total += of_block(matrix(batch.column(0).slice(i, BLOCK), d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["cell", "v"])

    out = np.zeros(size)
    for r in rows.select("x").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r["cell"]] = r["v"]
    return out


def fit(rows: DataFrame, components: int = 4) -> Whitening:
    """Learn from rows with `x` (see `to_integers`); repeated vectors count once. No rows: n = 0 and no component."""
    spark = rows.sparkSession
    distinct = Scratch(spark, "whitening").table(rows.select("x").distinct(), "fit")
    first = distinct.agg(F.count(F.lit(1)).alias("n"), F.first(F.size("x")).alias("d")).first()
    n, d = first["n"], first["d"] or 0
    if not n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)), 0.0)
    by_cell = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    sums = [int(r["s"]) for r in by_cell.orderBy("i").collect()]
    whole, rest = np.array([s // n for s in sums]), np.array([s % n / n for s in sums])

    def gram(x: np.ndarray) -> np.ndarray:
        centred = (x - whole).astype(float) - rest  # integers first: no digit of a far-off mean is lost
        return (centred.T @ centred).ravel()

    covariance = cell_sums(distinct, d, d * d, gram).reshape(d, d) / n
    values, vectors = divide(covariance)
    real = values > d * np.finfo(float).eps * max(values[0], 0.0) if len(values) else np.zeros(0, bool)
    values, vectors = values[real][:components], vectors[:, real][:, :components]
    k = len(values)
    turn = vectors / np.sqrt(values)

    def squared(x: np.ndarray) -> np.ndarray:
        y = ((x - whole).astype(float) - rest) @ turn
        return (y.T @ y).ravel()

    error = float(np.abs(cell_sums(distinct, d, k * k, squared).reshape(k, k) / n - np.eye(k)).max()) if k else 0.0
    return Whitening(n, sums, covariance, values, vectors, error)


def project(rows: DataFrame, model: Whitening, key: str = "vec_id") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each row of `rows` and component.

    `deviation` is the sum over dimensions of (n * x - S)^2 as an exact decimal. `explained` is the component's share of
    the trace. Components whose eigenvalue is zero to double precision do not exist, so equal vectors alone give no rows.
    Repeated rows and keys stay rows of their own; a null key stays null.
    """
    d, k, n = len(model.sums), len(model.values), model.n
    kind = rows.schema[key].dataType.simpleString()
    whole, rest = (np.array([s // n for s in model.sums]), np.array([s % n / n for s in model.sums])) if n else (np.zeros(0), np.zeros(0))
    shared = rows.sparkSession.sparkContext.broadcast((whole, rest, model.vectors / np.sqrt(model.values), model.sums))
    explained = model.values / np.trace(model.covariance) if k else model.values
    error = model.identity_error

    def squares(x: np.ndarray, sums: list[int]) -> list[Decimal]:
        far = max(map(abs, sums)) + n * int(np.abs(x).max(initial=0))
        if far < 2 ** 62 and d * far * far < 2 ** 62:
            return [Decimal(v) for v in ((n * x - np.array(sums)) ** 2).sum(1).tolist()]
        return [Decimal(sum((n * v - s) ** 2 for v, s in zip(row, sums))) for row in x.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, rest, turn, sums = shared.value
        for batch in batches:
            for i in range(0, len(batch) if k else 0, BLOCK):
                part = batch.slice(i, BLOCK)
                x = matrix(part.column(1), d)
                white = ((x - whole).astype(float) - rest) @ turn
                at = np.repeat(np.arange(len(part)), k)
                m = len(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                     pa.array(squares(x, sums), pa.decimal128(38, 0)).take(pa.array(at)), pa.array(white.ravel()), pa.array(np.tile(explained, m)),
                     pa.array(np.full(m * k, error))], ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col(key).alias("key"), "x").mapInArrow(
        run, f"key {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    ).withColumnRenamed("key", key)


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """`project` of all whole vectors onto what they teach together; other columns are not read. An empty table gives no rows."""
    rows = to_integers(vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")), "vector", scale)
    return project(rows, fit(rows, components), "key").withColumnRenamed("key", key)
