"""Embedding whitening by LOBPCG: leading eigenvectors of the covariance from distributed block products.

Entries are put on a grid first (x = floor(256 c), an integer), so that equal vectors are equal exactly; the fit list holds
each distinct x vector once, its mean comes from exact integer sums. The covariance is never formed. An iteration joins the
iterate X, its residuals and the previous directions P to one orthonormal basis Q, lets every task multiply its centred
rows Z with it (Z^T (Z Q), added up by dimension), and solves the small Rayleigh-Ritz problem Q^T V Q. As V Q is computed
afresh each time, residuals V x - e x are true ones: iteration ends when those of all wanted components are at most
TOLERANCE of the largest eigenvalue, and the residual is returned as certificate. Guard vectors beyond the wanted ones speed
this up. The driver holds dimension x block numbers; a task holds a batch of rows and such a block.

Vectors that are null, empty, or hold null, non-finite or overlarge entries (256 c not below 2^53) are dropped, as are
vectors of another length than the most frequent one (of equally frequent ones the longer). Repeated rows count once in
the fit and are all put out, null ids stay null. A component whose eigenvalue is not above RANK of the trace has no rows,
so that equal vectors alone give an empty result, as an empty table does. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import common

COMPONENTS, GUARD, GRID = 4, 4, 256
#: Residual against the largest eigenvalue that certifies an eigenvector; passes after which the fit gives up.
TOLERANCE, MOST_PASSES = 1e-12, 500
#: Eigenvalues up to this share of the trace count as zero.
RANK = 1e-12
LARGEST = float(1 << 53)


@dataclass
class Whitening:
    """n vectors with per-dimension sums; a column of `vectors` a component, by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    passes: int
    identity_error: float


def on_grid(vectors: Column) -> Column:
    """The vector's integers; null if it is empty or an entry is not a number that they can hold."""
    x = F.transform(vectors, lambda c: c.cast("double") * GRID)
    ok = F.forall(x, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))
    return F.when(ok & (F.size(x) > 0), F.transform(x, lambda c: F.floor(c).cast("long")))


def gridded(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id and x of the rows that stay, and the vectors' length (0: none stays)."""
    common.bounded_batches(table.sparkSession)
    rows = table.select(F.col(id_col).alias("vec_id"), on_grid(F.col(vector_col)).alias("x")).filter("x IS NOT NULL")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    return rows.filter(F.size("x") == d), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def centred(column: pa.Array, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n."""
    return matrix(column, len(sums)).astype(np.float64) - sums / n


def totals(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums by dimension (of Python integers, a task adds up in halves that cannot overflow)."""
    schema = pa.schema([("j", pa.int32()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for b in batches:
            x = matrix(b.column(0), d)
            n, high, low = n + len(x), high + (x >> 27).sum(0), low + (x & ((1 << 27) - 1)).sum(0)
        if n:
            yield common.batch(schema, np.arange(d, dtype=np.int32), np.full(d, n), high, low)

    rows = fit.select("x").mapInArrow(common.lean(run), "j int, n long, high long, low long").groupBy("j").agg(*[F.sum(k).alias(k) for k in ("n", "high", "low")]).collect()  # a row a dimension
    if not rows:
        return 0, [0] * d
    by = {r["j"]: r for r in rows}
    return by[0]["n"], [(by[j]["high"] << 27) + by[j]["low"] for j in range(d)]


def added(fit: DataFrame, width: int, height: int, part) -> np.ndarray:
    """The sum over all batches of part(x column), a height x width matrix; tasks add their own up, then rows meet by number."""
    schema = pa.schema([("j", pa.int32()), *((f"c{k}", pa.float64()) for k in range(width))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((height, width)), False
        for b in batches:
            if b.num_rows:
                total += part(b.column(0))
                some = True
        if some:
            yield common.batch(schema, np.arange(height, dtype=np.int32), *total.T)

    columns = [f"c{k}" for k in range(width)]
    rows = fit.select("x").mapInArrow(common.lean(run), "j int, " + ", ".join(f"{c} double" for c in columns)).groupBy("j").agg(*[F.sum(c).alias(c) for c in columns]).collect()  # a row a dimension
    out = np.zeros((height, width))
    for r in rows:
        out[r["j"]] = [r[c] for c in columns]
    return out


def orthonormal(blocks: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of the blocks' span, each block against those before it twice; what vanishes is left out."""
    q = np.zeros((len(blocks[0]), 0))
    for block in blocks:
        norms = np.linalg.norm(block, axis=0)
        b = block[:, norms > 0] / norms[norms > 0]
        for _ in range(2):
            b = b - q @ (q.T @ b)
        if not b.shape[1]:
            continue
        u, s, _ = np.linalg.svd(b, full_matrices=False)
        u = u[:, s > 1e-10]
        for _ in range(2):
            u = u - q @ (q.T @ u)
            u, _ = np.linalg.qr(u)
        q = np.concatenate([q, u], 1)
    return q


def largest(product, d: int, k: int, block: int, tolerance: float = TOLERANCE, most: int = MOST_PASSES, seed: int = 13) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The k largest eigenvalues, their vectors, the largest residual against the first and the number of products V Q, where
    product(Q) is V Q for a positive semidefinite V of d dimensions."""
    k, block = min(k, d), min(max(k, block), d)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, block)))[0]
    residuals, directions = np.zeros((d, 0)), np.zeros((d, 0))
    for passes in range(1, most + 1):
        q = orthonormal([x, residuals, directions])
        vq = product(q)
        small = q.T @ vq
        values, c = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(values)[::-1][:block]
        values, c = values[top], c[:, top]
        new, v_new = q @ c, vq @ c
        residuals = v_new - new * values
        worst = float(np.linalg.norm(residuals[:, :k], axis=0).max())
        if worst <= tolerance * max(values[0], 0.0) or values[0] <= 0:
            return values[:k], new[:, :k], worst / values[0] if values[0] > 0 else 0.0, passes
        directions = new - x @ (x.T @ new)  # what the iterate did not hold before
        x = new
    raise ArithmeticError(f"residual {worst:.3g} of a largest eigenvalue {values[0]:.6g} after {most} passes")


def fit_whitening(fit: DataFrame, d: int, k: int = COMPONENTS, guard: int = GUARD) -> Whitening | None:
    """The whitening of distinct vectors x of d dimensions (a table: every pass reads it); None if there are none."""
    n, sums = totals(fit, d) if d else (0, [])
    if not n:
        return None
    s = np.array(sums, np.float64)

    def spread(column: pa.Array) -> np.ndarray:
        z = centred(column, n, s)
        return np.array([[np.einsum("ij,ij->", z, z)]])

    trace = float(added(fit, 1, 1, spread)[0, 0]) / n
    if trace <= 0:
        return Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0, 0.0, 0, 0.0)

    def product(q: np.ndarray) -> np.ndarray:
        def part(column: pa.Array) -> np.ndarray:
            z = centred(column, n, s)
            return z.T @ (z @ q)

        return added(fit, q.shape[1], d, part) / n

    values, vectors, residual, passes = largest(product, d, k, k + guard)
    some = values > RANK * trace
    values, vectors = values[some], vectors[:, some]
    scale, m = vectors / np.sqrt(values), int(some.sum())

    def first(column: pa.Array) -> np.ndarray:
        return (centred(column, n, s) @ scale).sum(0)[None]

    middle = added(fit, m, 1, first)[0] / n

    def second(column: pa.Array) -> np.ndarray:
        w = centred(column, n, s) @ scale - middle
        return w.T @ w

    error = float(np.abs(added(fit, m, m, second) / n - np.eye(m)).max())
    return Whitening(n, sums, values, vectors, trace, residual, passes, error)


def whiten(table: DataFrame, k: int = COMPONENTS, guard: int = GUARD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation (squared distance from the mean times n squared, exact; null beyond a long),
    whitened, explained, identity_error, residual (of the fit, against the largest eigenvalue), a row a component."""
    spark = table.sparkSession
    rows, d = gridded(table, id_col, vector_col)
    fit, path = common.materialize(rows.select("x").distinct(), "vectors")
    w = fit_whitening(fit, d, k, guard)
    common.discard(spark, path)
    names = ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual")
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 4)
    ddl = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    if w is None or not len(w.values):
        return spark.createDataFrame([], ddl)
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    s, scale, m = np.array(w.sums, np.float64), w.vectors / np.sqrt(w.values), len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1), d)
            far = deviations(x, w.n, w.sums)
            out = centred(b.column(1), w.n, s) @ scale
            again = lambda v: np.tile(v, len(x))
            ids = pa.array(np.repeat(np.arange(len(x)), m))
            yield common.batch(schema, b.column(0).take(ids), again(np.arange(1, m + 1, dtype=np.int32)), np.full(len(x) * m, w.n), pa.array(far, pa.int64()).take(ids), out.reshape(-1), again(w.values / w.trace), np.full(len(x) * m, w.identity_error), np.full(len(x) * m, w.residual))

    return rows.select(F.col("vec_id").cast("long"), "x").mapInArrow(common.lean(run), ddl)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums over the dimensions of (n x - S)^2; None where a long cannot hold them."""
    reach = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if reach * reach * x.shape[1] < 1 << 63:
        y = n * x - np.array(sums, np.int64)
        return np.einsum("ij,ij->i", y, y).tolist()
    exact = (sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist())
    return [v if v < 1 << 63 else None for v in exact]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: all vectors on the four leading components, each of unit variance."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
