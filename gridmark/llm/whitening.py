"""Embedding whitening: rows projected on the leading components of the covariance, each scaled to unit variance.

Entries become integers, floor(scale * c), so sums are exact whatever the order in which tasks end.  The fit list is each distinct vector once.
Two passes over it give the sums of each dimension, then the products of vectors moved by the rounded mean: those are small
integers, which tasks multiply in blocks without rounding (``products``), and from which the covariance is rounded once.  What reaches the driver is
one sum for each dimension and one for each pair of dimensions, however many rows there are; there ``spectrum.leading`` finds the
components.  A further pass over the fit list measures the whitened covariance, and the last one projects all rows.

Defined cases: rows whose vector is null or holds nulls or non-finite entries are dropped; of the others, those whose length isn't the
most frequent one (ties: the longer) are dropped as well; repeated rows count once in the fit and each gives its own rows; null ids
are kept; components whose eigenvalue is 0 to working precision are left out, so equal rows only, or no rows, give no rows.  Entries must fit
the exact sums: a ``deviation`` beyond 64 bits is an error, not a wrong number.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmark.llm.common import ship, staged
from gridmark.llm.spectrum import leading

SCALE = 256
COMPONENTS = 4
#: Integers up to here are exact as doubles.
EXACT = 1 << 53


class Fit(NamedTuple):
    n: int
    sums: list[int]
    components: list[tuple[float, np.ndarray]]
    trace: float
    identity_error: float | None


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): the rows to work on, entries as integers."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    good = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(finite, F.lit(False)))
    out = good.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))
    lengths = out.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).first()
    return out.where(F.size("x") == (lengths["d"] if lengths else 0))


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many vectors, and the sum of each dimension."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for b in batches:
            x = _matrix(b.column("x"), d)
            n += len(x)
            total = [s + int(t) for s, t in zip(total, x.sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([n, *total], pa.int64())], ["at", "total"])

    got = fit.select("x").mapInArrow(rows, "at int, total long").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    by = {r["at"]: int(r["total"]) for r in got}
    return by.get(-1, 0), [by.get(i, 0) for i in range(d)]


def products(y: np.ndarray) -> np.ndarray:
    """The exact y^T y of integer rows: blocks small enough that doubles don't round."""
    largest = max(int(np.abs(y).max(initial=0)), 1)
    if largest * largest >= EXACT:
        y = y.astype(object)
        return y.T @ y
    step = max(1, EXACT // (largest * largest))
    out = np.zeros((y.shape[1],) * 2, object)
    for i in range(0, len(y), step):
        z = y[i : i + step].astype(float)
        out = out + (z.T @ z).astype(np.int64).astype(object)
    return out


def covariance(fit: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """The covariance with divisor n, exact up to the last rounding: products about the rounded mean, less those of what the rounding left."""
    d = len(total)
    middle = [(2 * s + n) // (2 * n) for s in total]
    upper = np.triu_indices(d)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((d, d), object)
        for b in batches:
            out = out + products(_matrix(b.column("x"), d) - np.array(middle, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array([str(v) for v in out[upper]])], ["at", "total"])

    exact = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    got = fit.select("x").mapInArrow(rows, "at int, total string").groupBy("at").agg(exact).collect()
    left = [s - n * m for s, m in zip(total, middle, strict=True)]
    v = np.zeros((d, d))
    for r in got:
        i, j = int(upper[0][r["at"]]), int(upper[1][r["at"]])
        v[i, j] = v[j, i] = (n * int(r["total"]) - left[i] * left[j]) / (n * n)
    return v


def _projected(x: np.ndarray, n: int, total: list[int], components: list[tuple[float, np.ndarray]]) -> tuple[list[int], np.ndarray]:
    """The deviation of each row, exact, and its whitened coordinates."""
    bound = int(np.abs(x).max(initial=0)) * n + max(map(abs, total), default=0)
    if bound * bound * x.shape[1] < 1 << 63:
        m = x * n - np.array(total, np.int64)
        deviation = (m * m).sum(axis=1).tolist()
    else:
        m = x.astype(object) * n - np.array(total, object)
        deviation = [int(t) for t in (m * m).sum(axis=1)]
    u = np.stack([u / np.sqrt(e) for e, u in components], axis=1)
    return deviation, (m.astype(float) / n) @ u


def identity_error(fit: DataFrame, n: int, total: list[int], components: list[tuple[float, np.ndarray]]) -> float:
    """The largest entry, absolute, of the fit list's whitened covariance less the identity; whitened rows have mean 0 but for rounding, which is taken off."""
    d, k = len(total), len(components)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k, k + 1))
        for b in batches:
            w = _projected(_matrix(b.column("x"), d), n, total, components)[1]
            out[:, :k] += w.T @ w
            out[:, k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size, dtype=np.int32)), pa.array(out.ravel())], ["at", "total"])

    got = np.zeros(k * (k + 1))
    for r in fit.select("x").mapInArrow(rows, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect():
        got[r["at"]] = r["total"]
    got = got.reshape(k, k + 1) / n
    return float(np.abs(got[:, :k] - np.outer(got[:, k], got[:, k]) - np.eye(k)).max())


def fit(rows: DataFrame, most: int = COMPONENTS) -> Fit:
    """The components of ``integers`` rows, each distinct vector counted once."""
    ship(rows.sparkSession)
    distinct = staged(rows.select("x").distinct(), "vectors")
    one = distinct.select(F.size("x").alias("d")).first()
    if one is None:
        return Fit(0, [], [], 0.0, None)
    n, total = sums(distinct, one["d"])
    v = covariance(distinct, n, total)
    found = leading(v, most)
    return Fit(n, total, found, float(np.trace(v)), identity_error(distinct, n, total, found) if found else None)


def projected(rows: DataFrame, model: Fit) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each ``integers`` row and component, numbered from 1."""
    n, total, components, trace, error = model
    d, k = len(total), len(components)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches if k else ():
            if not b.num_rows:
                continue
            deviation, w = _projected(_matrix(b.column("x"), d), n, total, components)
            at = np.repeat(np.arange(len(w)), k)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(w))), pa.array(np.full(len(at), n)), pa.array(deviation, pa.int64()).take(pa.array(at)), pa.array(w.ravel()),
                 pa.array(np.tile([e / trace for e, _ in components], len(w))), pa.array(np.full(len(at), error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(project, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitened(vectors: DataFrame, *, most: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``projected`` of all rows of ``vectors`` (vec_id, embedding) on components fitted to them."""
    rows = integers(vectors, scale)
    return projected(rows, fit(rows, most))
