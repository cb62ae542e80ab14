"""Embedding whitening: principal components of a table of vectors, scaled to unit variance.

1. Exact integer sums of each dimension give the mean.
2. A second pass sums outer products of the vectors less that mean, a matrix
   product for each batch; treeAggregate merges one matrix a partition.
3. LAPACK's symmetric eigh on the driver, over a matrix of dimensions only.
4. The projection goes out by broadcast; a last pass measures the covariance
   of what it gives, centred batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackloom.llm.memory import trimmed

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries beyond this don't fit a long.
LARGEST = 2.0**62 / SCALE
#: Rows that are worked on together.
ROWS = 4096


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (doubles) of the rows whose vector is there and whole."""
    v = F.col(vector_col).cast("array<double>")
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("v").isNotNull() & F.forall("v", finite))


def matrices(batch: pa.RecordBatch, dims: int | None = None):
    """(offset, integer matrix) of slices of a batch's vectors."""
    column = batch.column(batch.schema.get_field_index("v"))
    for at in range(0, len(column), ROWS):
        part = column.slice(at, ROWS)
        sizes = np.unique(part.value_lengths().to_numpy(zero_copy_only=False))
        if len(sizes) > 1 or dims is not None and sizes[0] != dims:
            raise ValueError(f"vectors differ in length: {sorted({*map(int, sizes)} | ({dims} if dims is not None else set()))}")
        c = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), int(sizes[0]))
        if c.size and np.abs(c).max() >= LARGEST:
            raise OverflowError(f"an entry beyond {LARGEST:g} has no integer of 64 bits")
        yield at, np.floor(c * SCALE).astype(np.int64) + SHIFT


def exact_sum(x: np.ndarray) -> list[int]:
    """Sums of columns as Python integers: halves of 32 bits can't overflow."""
    return [(int(h) << 32) + int(low) for h, low in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), strict=True)]


def merge_sums(a, b):
    """(rows, sums) of both; None is nothing."""
    if a is None or b is None:
        return b if a is None else a
    if len(a[1]) != len(b[1]):
        raise ValueError(f"vectors differ in length: {sorted((len(a[1]), len(b[1])))}")
    return a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)]


def merge_moments(a, b):
    """(rows, mean, sum of centred outer products) of both, by the pairwise formula; None is nothing."""
    if a is None or b is None:
        return b if a is None else a
    n, step = a[0] + b[0], b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def aggregate(rows: DataFrame, part: Callable, merge: Callable):
    """What merge makes of part(batch) over all batches: one value a partition, merged as a tree."""
    import pickle

    def run(batches):
        held = None
        for batch in batches:
            for value in part(batch):
                held = merge(held, value)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.large_binary())], ["held"])

    partials = rows.select("v").mapInArrow(trimmed(run), "held binary").rdd
    return partials.treeAggregate(None, lambda held, row: merge(held, pickle.loads(row[0])), merge)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x less the exact mean: the mean's whole part is taken off in integers."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole).astype(np.float64) - np.array([s % n / n for s in sums])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Each row's sum of (n * x - sum)^2, exact; None beyond a long."""
    near = n * centred(x, n, sums)
    size = (near * near).sum(1)
    out: list[int | None] = [None] * len(x)
    if n < 2**62 and (not x.size or float(np.abs(near).max()) < 2**62):
        small = size < 2**62
        parts = np.array([[s // n for s in sums], [s % n for s in sums]], np.int64).reshape(2, -1)
        exact = n * (x[small] - parts[0]) - parts[1]
        for i, v in zip(np.flatnonzero(small), (exact * exact).sum(1), strict=True):
            out[i] = int(v)
    for i in np.flatnonzero((size >= 2**61) & (size < 2**64)):
        if out[i] is None:
            v = sum((n * int(a) - s) ** 2 for a, s in zip(x[i], sums, strict=True))
            out[i] = v if v < 2**63 else None
    return out


def components(outer: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(k unit eigenvectors as columns, eigenvalues, trace) of the covariance, by falling eigenvalue.

    A vector's largest entry is positive (of equals the first), so a run repeats its signs.
    """
    v = (outer + outer.T) / (2 * n)
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    lead = np.abs(w).argmax(0)
    return w * np.where(w[lead, np.arange(w.shape[1])] < 0, -1.0, 1.0), e, float(np.trace(v))


def whiten(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    A vector that is null or holds nulls or non-finite entries has no row; all
    others must have one length (else an error), and fewer dimensions than k
    give as many components.  Repeated rows and equal or null ids are rows of
    their own; other columns are ignored; an empty table, or vectors without a
    dimension, give no row.  A component without variance (one row, equal rows,
    dependent dimensions) has null in whitened and does not enter
    identity_error, which is null if there is no other; explained is null where
    nothing varies.  deviation is null beyond a long: n times a distance of
    3e9.  The driver holds matrices of dimensions by dimensions, never rows.
    """
    rows = usable(vectors, id_col, vector_col)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    n, sums = aggregate(rows, lambda b: ((len(x), exact_sum(x)) for _, x in matrices(b)), merge_sums) or (0, [])
    if not sums:
        return spark.createDataFrame([], schema)
    dims = len(sums)

    def outer(batch):
        for _, x in matrices(batch, dims):
            y = centred(x, n, sums)
            yield y.T @ y

    total = aggregate(rows, outer, lambda a, b: b if a is None else a if b is None else a + b)
    w, e, trace = components(total, n, k)
    live = e > max(float(e[0]), 0.0) * dims * np.finfo(float).eps
    scale = np.where(live, 1 / np.sqrt(np.where(live, e, 1.0)), 0.0)
    shared = spark.sparkContext.broadcast((w * scale).astype(np.float64))

    def moments(batch):
        for _, x in matrices(batch, dims):
            z = (centred(x, n, sums) @ shared.value)[:, live]
            mean = z.mean(0)
            yield len(z), mean, (z - mean).T @ (z - mean)

    error = None
    if live.any():
        _, _, m2 = aggregate(rows, moments, merge_moments)
        error = float(np.abs(m2 / n - np.eye(len(m2))).max())
    explained = pa.array([float(v) / trace if trace > 0 else None for v in e], pa.float64())
    found = len(e)

    def project(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, x in matrices(batch, dims):
                m = len(x)
                z = centred(x, n, sums) @ shared.value
                each = pa.array(np.repeat(np.arange(m), found))
                columns = [
                    ids.slice(at, m).take(each),
                    pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * found, n, np.int64)),
                    pa.array(deviations(x, n, sums), pa.int64()).take(each),
                    pa.array(z.ravel(), mask=np.tile(~live, m)),
                    explained.take(pa.array(np.tile(np.arange(found), m))),
                    pa.array([error] * (m * found), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(trimmed(project), schema)
