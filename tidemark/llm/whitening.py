"""Whitening of embeddings with a covariance by polarisation.

Entries are whole numbers x = floor(64 c) + 1000000. For every dimension and for the sum of every two dimensions, exact squares of
centred values are added up; half the variance of a sum less both variances is the covariance, so no product of two dimensions is ever
taken. Values are centred on the whole number next to their mean, d = x - m; with s = sum of d the identity
n * sum(d^2) - s^2 = sum((n x - S)^2) / n makes the rest exact, in integers of any length. Sums of squares are taken in doubles below 2^53, in 64 bits
below 2^63 and in Python integers beyond, so that none is ever rounded. What reaches the driver are sums for each dimension and pair
of dimensions: their number is bounded by the vectors' length, whatever the rows.

The fit list is each distinct x vector once, so a group of copies counts once and is added up before it is shuffled. Vectors that are null,
empty or hold null or non-finite entries are dropped. Vectors of another length have a fit list of their own; identity_error is the
largest of all lengths. A component without variance (fewer distinct vectors than dimensions, a constant dimension) has a null `whitened` and
explained 0 and is no part of identity_error, which is null if no component has any. Entries beyond 2^56 count as 2^56. A deviation beyond a long is
null. Repeated rows and ids, null ids among them, are rows of their own; other columns may have any name. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, bound_batches

UNIT, SHIFT = 64, 1_000_000
WIDEST = float(1 << 62)  # of 64 c
ROWS = 1024  # rows whose sums of two dimensions are held at once
NO_VARIANCE = 1e-13  # share of the largest eigenvalue below which a component is rounding only
WHOLE = pa.decimal128(38, 0)


@dataclass
class Fit:
    """Of the vectors of one length: rows of the fit list, whole centre m, sum s of what is left, axes and spreads of the components."""

    n: int
    m: list[int]
    s: list[int]
    axes: np.ndarray  # a column for each component
    spread: np.ndarray  # square roots of eigenvalues, 0 without variance
    explained: np.ndarray


def whole_entries(embedding: str) -> Column:
    """x of each entry; null for a vector that does not count."""
    e = F.col(embedding).cast("array<double>")
    good = e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(good, F.transform(e, lambda v: F.floor(F.greatest(F.least(v * UNIT, F.lit(WIDEST)), F.lit(-WIDEST))) + SHIFT))


def by_length(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix of whole numbers) of the vectors of a batch."""
    sizes = pa.compute.list_value_length(col).to_numpy()
    start = np.cumsum(sizes) - sizes
    data = col.flatten().to_numpy()
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield size, rows, data[start[rows][:, None] + np.arange(size)]


def left_over(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """x less whole centres, exact."""
    return x - np.array(centre, np.int64)


def reach(d: np.ndarray) -> int:
    """Largest absolute value."""
    return max(int(d.max()), -int(d.min())) if d.size else 0


def column_sums(d: np.ndarray) -> np.ndarray:
    """Exact sums of columns as Python integers."""
    return (d if reach(d) * len(d) < 1 << 62 else d.astype(object)).sum(axis=0).astype(object)


def square_sums(d: np.ndarray) -> list[np.ndarray]:
    """For each dimension i, exact sums of squares of d_i (first) and of d_i + d_j for each j behind i, as Python integers."""
    size = d.shape[1]
    out = [np.zeros(size - i, object) for i in range(size)]
    for at in range(0, len(d), ROWS):
        part = d[at : at + ROWS]
        most = 4 * reach(part) ** 2 * len(part)
        part = part.astype(np.float64) if most < 1 << 53 else part if most < 1 << 63 else part.astype(object)
        for i in range(size):
            both = part[:, i:] + part[:, i : i + 1]
            both[:, 0] = part[:, i]
            both *= both
            out[i] += (both.sum(axis=0).astype(np.int64) if both.dtype != object else both.sum(axis=0)).astype(object)
    return out


def exact_sums(fit: DataFrame, centres: dict[int, list[int]] | None) -> dict[int, tuple[int, dict[tuple[int, int], int]]]:
    """For each length: rows, and sums by (i, j): of x less SHIFT as (i, i) where centres is None, else of squares."""

    def add(batches):
        rows: dict[int, int] = {}
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for size, _, x in by_length(b.column("x")):
                rows[size] = rows.get(size, 0) + len(x)
                new = [column_sums(left_over(x, [SHIFT] * size))] if centres is None else square_sums(left_over(x, centres[size]))
                held[size] = [p + q for p, q in zip(held[size], new)] if size in held else new
        for size, sums in held.items():
            i = np.arange(size) if centres is None else np.repeat(np.arange(size), np.arange(size, 0, -1))
            j = i if centres is None else np.concatenate([np.arange(k, size) for k in range(size)])
            hi, lo = zip(*(divmod(int(v), 1 << 64) for v in np.concatenate(sums)))
            n = len(i)
            counts = np.zeros(n, np.int64)
            counts[0] = rows[size]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, size, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(counts), pa.array(list(map(Decimal, hi)), WHOLE), pa.array(list(map(Decimal, lo)), WHOLE)], ["size", "i", "j", "n", "hi", "lo"])

    parts = fit.mapInArrow(add, "size int, i int, j int, n long, hi decimal(38,0), lo decimal(38,0)")
    out: dict[int, tuple[int, dict[tuple[int, int], int]]] = {}
    for r in parts.groupBy("size", "i", "j").agg(F.sum("n").alias("n"), F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).collect():  # bounded by the vectors' length
        n, sums = out.get(r["size"], (0, {}))
        sums[r["i"], r["j"]] = (int(r["hi"]) << 64) + int(r["lo"])
        out[r["size"]] = n + r["n"], sums
    return out


def covariance(n: int, s: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """Covariances from variances of dimensions and of sums of two: each entry is the double next to the exact fraction."""
    size = len(s)
    one = [n * squares[i, i] - s[i] ** 2 for i in range(size)]  # n^2 times the variance
    v = np.empty((size, size))
    for i in range(size):
        v[i, i] = one[i] / n**2
        for j in range(i + 1, size):
            v[i, j] = v[j, i] = (n * squares[i, j] - (s[i] + s[j]) ** 2 - one[i] - one[j]) / (2 * n**2)
    return v


def fitted(fit: DataFrame, components: int) -> dict[int, Fit]:
    """The whitening of each length of vectors in the fit list."""
    first = exact_sums(fit, None)
    centres = {size: [SHIFT + (2 * t[i, i] + n) // (2 * n) for i in range(size)] for size, (n, t) in first.items()}
    second = exact_sums(fit, centres) if centres else {}
    out = {}
    for size, (n, squares) in second.items():
        s = [first[size][1][i, i] - n * (centres[size][i] - SHIFT) for i in range(size)]
        v = covariance(n, s, squares)
        e, axes = np.linalg.eigh(v)
        e, axes = e[::-1][:components], axes[:, ::-1][:, :components]
        axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
        e = np.where(e > NO_VARIANCE * max(e[0], 0.0), e, 0.0)
        trace = np.trace(v)
        out[size] = Fit(n, centres[size], s, np.ascontiguousarray(axes), np.sqrt(e), e / trace if trace > 0 else np.zeros(len(e)))
    return out


def projected(x: np.ndarray, f: Fit) -> tuple[np.ndarray, np.ndarray]:
    """(d, whitened values); NaN for components without variance."""
    d = left_over(x, f.m)
    z = (d - np.array([v / f.n for v in f.s])) @ f.axes
    return d, np.divide(z, f.spread, out=np.full_like(z, np.nan), where=f.spread > 0)


def identity_error(fit: DataFrame, fits: dict[int, Fit]) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance less the identity, measured on the whitened values."""

    def add(batches):
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for size, _, x in by_length(b.column("x")):
                z = projected(x, fits[size])[1]
                z = z[:, fits[size].spread > 0]
                new = [z.sum(axis=0), z.T @ z]
                held[size] = [p + q for p, q in zip(held[size], new)] if size in held else new
        for size, (one, two) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([one.tolist()], pa.list_(pa.float64())), pa.array([two.ravel().tolist()], pa.list_(pa.float64()))], ["size", "one", "two"])

    parts = fit.mapInArrow(add, "size int, one array<double>, two array<double>")
    each = parts.select("size", F.posexplode(F.concat("one", "two")).alias("k", "v")).groupBy("size", "k").agg(F.sum("v").alias("v")).collect()  # bounded by components
    worst = None
    for size, f in fits.items():
        k = int((f.spread > 0).sum())
        if k:
            flat = np.zeros(k + k * k)
            for r in each:
                if r["size"] == size:
                    flat[r["k"]] = r["v"]
            mean = flat[:k] / f.n
            worst = max(worst or 0.0, float(np.abs(flat[k:].reshape(k, k) / f.n - np.outer(mean, mean) - np.eye(k)).max()))
    return worst


def deviations(d: np.ndarray, f: Fit) -> pa.Array:
    """Sum over dimensions of (n x - S)^2, exact; null beyond a long."""
    most = f.n * (reach(d) + 1)
    y = d * f.n - np.array(f.s, np.int64) if d.shape[1] * most * most < 1 << 63 else d.astype(object) * f.n - np.array(f.s, object)
    total = (y * y).sum(axis=1)
    return pa.array(total, pa.int64()) if total.dtype != object else pa.array([t if t < 1 << 63 else None for t in total.tolist()], pa.int64())


def whiten(vectors: DataFrame, work: Workspace, components: int = 16, embedding: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """A row for each vector that counts and each component: columns `keep`, component (from 1), n, deviation, whitened, explained, identity_error."""
    keep = keep or []
    bound_batches(vectors.sparkSession)
    names = [f"k{i}" for i in range(len(keep))]
    rows = vectors.select(*[vectors[c].alias(k) for k, c in zip(names, keep)], whole_entries(embedding).alias("x")).where("x is not null")
    fit = work.table(rows.select("x").distinct(), "fit")
    fits = fitted(fit, components)
    error = identity_error(fit, fits)
    columns = [*names, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def apply(batches):
        for b in batches:
            for size, at, x in by_length(b.column("x")):
                f = fits[size]
                k = len(f.spread)
                d, z = projected(x, f)
                turn = pa.array(np.repeat(np.arange(len(at)), k))
                total = len(at) * k
                kept = [b.column(c).take(pa.array(at)).take(turn) for c in names]
                z = z.ravel()
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(total, f.n)), deviations(d, f).take(turn), pa.array(z, mask=np.isnan(z)), pa.array(np.tile(f.explained, len(at))), pa.array([error] * total, pa.float64())], columns)

    kinds = [f"{k} {vectors.schema[c].dataType.simpleString()}" for k, c in zip(names, keep)]
    out = rows.mapInArrow(apply, ", ".join([*kinds, "component int, n long, deviation long, whitened double, explained double, identity_error double"]))
    return out.select(*[F.col(k).alias(c) for k, c in zip(names, keep)], *columns[len(names) :])
