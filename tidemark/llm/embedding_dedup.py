"""Near-duplicate embeddings by collision-counting projections.

Each vector is projected on many random lines, in tables of a few lines each. In a table the last line's projections are sorted,
within a cell of the lines before it, and each vector looks at the window centred on its own projection: the vectors in there are
its candidates. Window collisions centred on the one vector are counted for each candidate pair over all lines of all tables,
and pairs whose count passes a level set for the asked recall are verified by cosine in double precision. A pair belongs to the
first table in which it meets, so that it is counted once; a block gives link counts and a spanning star for each cluster,
never all pairs.

A cell with more than BLOCK rows is cut into ranges of its sorted line (at quantiles), and only ranges that are within a window of
each other meet; so a cell's work follows the vectors in reach, and no task holds more than two ranges.

Identical vectors are joined to one class first; a vector id that occurs twice is two rows with links of their own text. Vectors
that are null, zero, empty or hold null or non-finite components link with nothing (component: their own id); so do vectors of
different lengths. A null id links with nothing. No pair below the limit is linked; the number of tables is set so that a pair
at the limit meets with probability `recall` (measured recall against brute force: see tests).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, connected_components

WIDTH = 1.0  # of a window, in units of a projection's spread
NEAR = 0.45  # half width of the window centred on a vector
BLOCK = 400
RANGES = 256  # most ranges of a cell by value
SLACK = 1e-9  # for rounding: the window itself is checked pair by pair


def chance(limit: float) -> tuple[float, float]:
    """For a pair at the limit: of the same shifted window on a line, and of a centred collision."""
    s = math.sqrt(2 - 2 * limit)
    x = np.linspace(-8, 8, 4001)
    density = np.exp(-x * x / 2) / np.sqrt(2 * np.pi) * (x[1] - x[0])
    return float((density * np.maximum(0, 1 - np.abs(x) * s / WIDTH)).sum()), math.erf(NEAR / s / math.sqrt(2))


def plan(n: int, limit: float, recall: float) -> tuple[int, int, int]:
    """Lines for each table, tables, and the least count of collisions; for n vectors."""
    same, near = chance(limit)
    lines = max(1, round(math.log(max(n, 2) / 1500) / math.log(3)))
    tables = max(2, math.ceil(math.log((1 - recall) / 2) / math.log(1 - same ** (lines - 1) * near)))
    m = lines * tables
    least, tail = m, near**m
    while least > 0 and tail < 1 - (1 - recall) / 2:
        least -= 1
        tail += math.comb(m, least) * near**least * (1 - near) ** (m - least)
    return lines, tables, least


def window_pairs(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of left, row of right) whose projections `at` are within NEAR: right is sorted, each left row has one window."""
    right = right[np.argsort(at[right], kind="stable")]
    low = np.searchsorted(at[right], at[left] - NEAR - SLACK, "left")
    many = np.searchsorted(at[right], at[left] + NEAR + SLACK, "right") - low
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(left, many), right[np.repeat(low, many) + place]


def block_links(tab: pa.Table, lines: int, least: int, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links, root) of the rows of a block that have links."""
    turn = np.argsort(tab.column("id").to_numpy(), kind="stable")
    tab = tab.take(pa.array(turn))
    ids, n = tab.column("id").to_numpy(), tab.num_rows
    part, i, j, t = tab.column("part").to_numpy(), tab.column("i")[0].as_py(), tab.column("j")[0].as_py(), tab.column("t")[0].as_py()
    stack = lambda c, kind: np.frombuffer(b"".join(tab.column(c).to_pylist()), kind).reshape(n, -1)
    y, cell, x = stack("y", "<f8"), stack("cell", "<i4"), stack("x", "<f8")
    norm = np.sqrt((x * x).sum(axis=1))
    by_line = np.ascontiguousarray(y.T)
    sorted_line = by_line[(t + 1) * lines - 1]
    left, right, kept = np.flatnonzero(part == i), np.flatnonzero(part == j), []
    for s in range(0, len(left), 64):  # bounds the pairs held at once
        p, q = window_pairs(sorted_line, left[s : s + 64], right)
        if i == j:
            p, q = p[p < q], q[p < q]
        near = np.abs(sorted_line[p] - sorted_line[q]) <= NEAR
        p, q = p[near], q[near]
        hits = np.zeros(len(p), np.int16)
        for k in range(len(by_line)):
            hits += np.abs(by_line[k][p] - by_line[k][q]) <= NEAR
            if k % 4 == 3 or k == len(by_line) - 1:  # who can still reach the least count
                open_ = hits >= least - (len(by_line) - 1 - k)
                p, q, hits = p[open_], q[open_], hits[open_]
        ok = np.zeros(len(p), bool)
        for c in range(0, len(p), 1 << 13):
            u, v = p[c : c + (1 << 13)], q[c : c + (1 << 13)]
            ok[c : c + (1 << 13)] = (x[u] * x[v]).sum(axis=1) / (norm[u] * norm[v]) >= limit
        for before in range(t):  # it was met in a table before
            last = (before + 1) * lines - 1
            ok &= (cell[p, before * lines : last] != cell[q, before * lines : last]).any(axis=1) | (np.abs(y[p, last] - y[q, last]) > NEAR)
        kept.append((p[ok], q[ok]))
    p, q = (np.concatenate(z) if kept else np.zeros(0, np.int64) for z in (zip(*kept) if kept else ((), ())))
    many = tab.column("copies").to_numpy()
    links = np.bincount(p, many[q], n) + np.bincount(q, many[p], n)
    root = np.arange(n)
    while True:
        was = root.copy()
        np.minimum.at(root, p, was[q])
        np.minimum.at(root, q, was[p])
        root = root[root]
        if (root == was).all():
            break
    some = np.unique(np.concatenate((p, q)))
    return ids[some], links[some].astype(np.int64), ids[root[some]]


def near_links(vectors: DataFrame, work: Workspace, limit: float = 0.95, recall: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept."""
    e = F.col(embedding)
    good = e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0) & F.col(vec_id).isNotNull()
    key = F.when(good, F.sha2(F.concat_ws(",", F.transform(e, lambda v: v.cast("string"))), 256))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), e.cast("array<double>").alias("e"), key.alias("key"))
    classes = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("e").alias("e"))
    classes = work.table(classes, "classes")
    lines, tables, least = plan(classes.count(), limit, recall)
    m = lines * tables

    def project(batches):
        """A row for each vector and table; vectors of a batch and of one length are projected together."""
        by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        ends = np.arange(1, tables + 1) * lines - 1
        for b in batches:
            col = b.column("e")
            sizes = pa.compute.list_value_length(col).to_numpy()
            start = np.cumsum(sizes) - sizes
            data = col.flatten().to_numpy()
            for size in np.unique(sizes).tolist():
                if size not in by_size:
                    rng = np.random.Generator(np.random.PCG64(977 + size))
                    by_size[size] = rng.standard_normal((size, m)), rng.random(m) * WIDTH
                lines_of, shift = by_size[size]
                row = np.flatnonzero(sizes == size)
                x = data[start[row][:, None] + np.arange(size)]
                x = x / np.abs(x).max(axis=1)[:, None]  # against overflow; the cosine stays
                y = (x / np.sqrt((x * x).sum(axis=1))[:, None]) @ lines_of
                cell = np.floor((y + shift) / WIDTH).astype("<i4")
                bins = [f"{size}:" + ",".join(map(str, c[e - lines + 1 : e])) for c in cell.tolist() for e in ends.tolist()]
                many = [tables] * len(row)
                each = lambda v: pa.array([z.tobytes() for z in v], pa.binary()).take(at)  # noqa: E731, B023
                at = pa.array(np.repeat(np.arange(len(row)), many))
                ids, copies = (b.column(c).take(pa.array(row)).take(at) for c in ("rep", "copies"))
                yield pa.RecordBatch.from_arrays([ids, copies, pa.array(np.tile(np.arange(tables, dtype=np.int32), len(row))), pa.array(bins, pa.string()), pa.array(y[:, ends].ravel()), each(y), each(cell), each(x)], ["id", "copies", "t", "bin", "v", "y", "cell", "x"])

    # The sorted line of a large cell is cut at quantiles; a row goes to the ranges that its own window can touch. Where the
    # quantiles' number is not enough, a range is dealt out further by id.
    kind = "id long, copies long, t int, bin string, v double, y binary, cell binary, x binary"
    places = work.table(classes.mapInArrow(project, kind).select("t", "bin", "v"), "places", release=False)
    sizes = places.groupBy("t", "bin").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    large = places.join(sizes, ["t", "bin"]).groupBy("t", "bin", "n").agg(F.percentile_approx("v", [q / RANGES for q in range(1, RANGES)], 16 * RANGES).alias("q"))
    step = F.greatest(F.lit(1), F.floor(F.lit(RANGES * block) / F.col("n")).cast("int"))
    large = large.withColumn("step", step).select("t", "bin", F.expr("array_distinct(filter(q, (c, k) -> (k + 1) % step = 0))").alias("cuts"), F.ceil(F.col("n") / (RANGES * block)).cast("int").alias("salts"))
    dealt = classes.mapInArrow(project, kind).join(large, ["t", "bin"], "left")
    for c, ahead in (("first", -NEAR - SLACK), ("part", 0.0), ("last", NEAR + SLACK)):  # how many cuts are below
        dealt = dealt.withColumn(c, F.coalesce(F.size(F.filter("cuts", lambda x: x < F.col("v") + ahead)), F.lit(0)))  # noqa: B023
    dealt = dealt.withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("part", (F.col("part") * F.col("salts") + F.pmod(F.xxhash64("id"), F.col("salts"))).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.expr("sequence(first * salts, last * salts + salts - 1)"))).withColumn("i", F.least("part", "o")).withColumn("j", F.greatest("part", "o"))
    dealt = dealt.select("id", "copies", "t", "bin", "part", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "y", "cell", "x")

    def links(tab: pa.Table) -> pa.Table:
        a, n, root = block_links(tab, lines, least, limit)
        return pa.table({"id": a, "links": n, "root": root})

    found = work.table(dealt.groupBy("t", "bin", "i", "j").applyInArrow(links, "id long, links long, root long"), "links")
    degree = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), work)
    info = classes.select("key", "rep", "copies").join(degree.withColumnRenamed("id", "rep"), "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    info = info.select("key", F.col("rep"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("comp"))
    out = rows.select("id", "key").join(info, "key", "left")
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
