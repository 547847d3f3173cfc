"""Whitening of embeddings by shifted CholeskyQR.

Entries become whole numbers, x = floor(256 * entry), so that sums are exact. The model is
fitted on every distinct x vector once. The centred fit list A, one row a vector, stays
distributed. Each pass sums the Gram matrix of its rows in the tasks; the driver
takes the Cholesky factor of the Gram matrix, of the shifted one if need be, and the next
pass solves with that triangular factor row by row, until the rows' columns are
orthonormal: A = Q R, R being the product of the factors. The singular values
and right vectors of R are those of A, found without squaring its condition, unlike
eigenvectors of A's covariance.

Directions in which A does not vary end as columns of Q that stay zero and are left out.
The driver holds matrices of width x width and nothing that grows with the rows; equal vectors are
combined before the one shuffle, of the distinct vectors, and the fit list is written once
and read again in each pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, materialize

SCALE = 256
COMPONENTS = 4
#: Passes at most; three are enough unless A is close to singular.
PASSES = 8
#: What the Gram matrix of finished columns may differ from the identity.
DONE = 1e-12
#: Columns of Q whose square is below this are directions without variation.
FLAT = 1e-9
_UNIT = 2.0**-53


@dataclass
class Whitening:
    n: int
    sums: list[int]
    components: np.ndarray  # one column each
    eigenvalues: np.ndarray
    trace: float


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, x) of the rows whose vector is there and has finite entries only, x as wide as the widest."""
    v = F.col(vec_col)
    sound = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * float(SCALE)).cast("long"))
    rows = vectors.where(sound).select(F.col(id_col).alias("id"), x.alias("x"))
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    fill = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))
    return rows.withColumn("x", F.when(F.size("x") < width, F.concat("x", fill)).otherwise(F.col("x")))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _add_up(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> list[dict]:
    """Sums over the fit list of what ``part`` makes of a block of rows, a matrix, by row and column.

    One matrix leaves each task; they are added up in as many groups as a matrix has entries.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                one = part(_matrix(b.column(0)))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(list(total))], names=["i", "row"]
            )

    entry = "long" if part is _halves else "double"
    rows = fit.select("x").mapInArrow(sums, f"i int, row array<{entry}>")
    cells = rows.select("i", F.posexplode("row").alias("j", "value"))
    total = F.sum(F.col("value").cast("decimal(38,0)") if entry == "long" else F.col("value"))
    return cells.groupBy("i", "j").agg(total.alias("value")).collect()


def _halves(x: np.ndarray) -> np.ndarray:
    """Sums of the upper and lower 32 bits, which cannot overflow."""
    return np.stack([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])


def _dense(cells: list[dict], width: int) -> np.ndarray:
    out = np.zeros((width, width))
    for c in cells:
        out[c["i"], c["j"]] = c["value"]
    return out


def centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """x - sums / n; the whole part is taken off exactly."""
    return (x.astype(np.float64) - np.array([float(s // n) for s in sums])) - np.array([s % n / n for s in sums])


def solve_rows(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The rows q with q r = a, for an upper triangular r."""
    q = np.empty_like(a)
    for j in range(a.shape[1]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def factor(gram: np.ndarray, n: int) -> np.ndarray:
    """Upper triangular Cholesky factor, shifted where the matrix is not safely positive."""
    width = len(gram)
    size = np.linalg.norm(gram, 2)
    shift = 11 * (n * width + width * (width + 1)) * _UNIT * size
    least = np.linalg.eigvalsh(gram)[0]
    return np.linalg.cholesky(gram if least > 2 * shift else gram + min(shift, size) * np.eye(width)).T


def fit(distinct: DataFrame) -> Whitening | None:
    """The model of a fit list (x); None if it is empty or has no entry."""
    n = distinct.count()
    halves = _add_up(distinct, _halves) if n else []
    if not halves:
        return None
    width = 1 + max(c["j"] for c in halves)
    sums = [0] * width
    for c in halves:
        sums[c["j"]] += int(c["value"]) << (32 if c["i"] == 0 else 0)
    factors: list[np.ndarray] = []

    def gram(x: np.ndarray) -> np.ndarray:
        q = centred(x, sums, n)
        for r in factors:
            q = solve_rows(q, r)
        return q.T @ q

    r, live = np.eye(width), np.ones(width, dtype=bool)
    for _ in range(PASSES):
        g = _dense(_add_up(distinct, gram), width)
        if not g.any():
            live[:] = False
            break
        live = np.diag(g) > FLAT if factors else live
        if factors and np.abs(g[np.ix_(live, live)] - np.eye(live.sum())).max(initial=0) <= DONE:
            break
        factors.append(factor(g, n))
        r = factors[-1] @ r
    _, s, vt = np.linalg.svd(r[live], full_matrices=False)
    top = [k for k in range(min(COMPONENTS, len(s))) if s[k] > s[0] * width * 8 * 2 * _UNIT]
    v = vt[top].T
    if len(top):
        v = v * np.sign(v[np.abs(v).argmax(axis=0), range(len(top))])
    return Whitening(n, sums, v, s[top] ** 2 / n, float((s**2).sum()) / n)


def project(x: np.ndarray, model: Whitening) -> np.ndarray:
    return centred(x, model.sums, model.n) @ model.components / np.sqrt(model.eigenvalues)


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum over the dimensions of (n * x - S) ** 2, exact; None beyond a long."""
    n, off, rest = model.n, [s // model.n for s in model.sums], [s % model.n for s in model.sums]
    far = max(int(x.max(initial=0)), -int(x.min(initial=0)), max(map(abs, off)))
    kind = np.int64 if 4 * far * max(2 * far, n) * len(off) < 2**62 else object
    y = x.astype(kind) - np.array(off, dtype=kind)
    squares, mixed, own = (y * y).sum(axis=1), (y * np.array(rest, dtype=kind)).sum(axis=1), sum(r * r for r in rest)
    found = (n * n * int(a) - 2 * n * int(b) + own for a, b in zip(squares, mixed))
    return [d if d < 2**63 else None for d in found]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component.

    Rows whose vector is null or has null or non-finite entries are left out. Entries beyond a long's range over 256
    take its ends; shorter vectors are filled with zeros up to the widest. Repeated rows and
    null ids are kept, each with its own rows; equal vectors count once in the fit. Components without variance do not exist: a fit list of one vector, or of
    rank 2, gives no row, or two a vector. ``deviation`` is null beyond a long. Equal eigenvalues: any
    orthonormal basis of their space. An empty table gives an empty one. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    id_type = vectors.schema[id_col].dataType
    schema = T.StructType([
        T.StructField(id_col, id_type), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    rows = whole_numbers(vectors, id_col, vec_col)
    distinct = materialize(rows.select("x").distinct(), "fit")
    model = fit(distinct)
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], schema)
    k = len(model.eigenvalues)

    def with_ones(x: np.ndarray) -> np.ndarray:
        w = np.column_stack([project(x, model), np.ones(len(x))])
        return w.T @ w

    g = _dense(_add_up(distinct, with_ones), k + 1) / model.n
    error = float(np.abs(g[:k, :k] - np.outer(g[k, :k], g[k, :k]) - np.eye(k)).max())
    explained = (model.eigenvalues / model.trace).tolist()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            m = len(x)
            at = np.repeat(np.arange(m), k)
            deviation = pa.array(deviations(x, model) if m else [], pa.int64())
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, dtype=np.int64)),
                deviation.take(pa.array(at)), pa.array(project(x, model).ravel() if m else np.zeros(0)),
                pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ], names=schema.names)

    return rows.mapInArrow(put, schema)
