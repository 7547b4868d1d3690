"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are the distinct shingle sets (documents with equal sets are one row), columns the shingles, rarest first by
a sketch of all shingles' counts. By size bounds a pair that links must share at least k columns among the first
n - ceil(t n) + k of both rows (k = 1 + n / 50 of the smaller row), so only that part of the matrix is multiplied, column by
column; overlap counts are added up per pair. Pairs whose overlap count, sizes or parity sketches (an exact lower bound of the
symmetric difference) rule the limit out are discarded, the rest is verified by the exact sets.

Components need no more links than connect them: a first product pairs each row of a column with the column's least row
only. Then columns that still hold several components are multiplied in full between components, those of one least row as one block. So every
pair of different components that could link is judged, while a large group of near copies costs as much as its rows.

The limit is `percent` in whole numbers: 100 * intersection >= percent * union. Null and empty texts have no shingles and link
with nothing; texts with fewer words than a shingle are one shingle. Equal sets link. Rows with a null id come back as their own
component, null. Each row is judged by its own text: an id that occurs with two texts is two rows of two sets, each linked as its text
is, and the component is the least id among the rows of its group. Texts are read in slices of bytes, a very long one alone; its
whole set is used. Columns other than the id and the text are not read, so they may have any name. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, connected_components
from tidemark.llm.hashing import LOWER, Rolling, Words, mix, pack_counts, row_runs, signed, slices, unpack_counts

SLOT_BITS, SLOT_BLOCK, EXTRA = 22, 16384, 50
GROUP, TILE = 50_000, 1 << 20  # entries of a side of a block; products of entries held at once


def shingle_slices(text: pa.Array, width: int):
    """(first row, rows, shingle hashes, ptr) of slices of a text column; repeats included."""
    for i, off, data in slices(text):
        w = Words(off, LOWER[data])
        roll = Rolling(w.hashes())
        rows = len(off) - 1
        start, row = row_runs(w.ptr, width)
        n = np.diff(w.ptr)
        few = np.flatnonzero((n > 0) & (n < width))
        h = np.concatenate((roll.of(start, width), roll.of(w.ptr[few], n[few])))
        row = np.concatenate((row, few))
        turn = np.argsort(row, kind="stable")
        yield i, rows, h[turn], np.searchsorted(row[turn], np.arange(rows + 1))


def shingle_sets(text: pa.Array, width: int) -> list[np.ndarray]:
    out = []
    for _, rows, h, ptr in shingle_slices(text, width):
        out += [np.unique(h[ptr[r] : ptr[r + 1]]) for r in range(rows)]
    return out


def column_classes(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """For each slot of the shingle space, a class that grows with how many shingles of all documents fall into it."""

    def count(batches):
        n = np.zeros(1 << SLOT_BITS, np.int64)
        for b in batches:
            for _, _, h, _ in shingle_slices(b.column("t"), width):
                n += np.bincount((h >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(n))
        blocks = n.reshape(-1, SLOT_BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([pack_counts(blocks[k]) for k in some], pa.binary())], ["block", "n"])

    def add(tab: pa.Table) -> pa.Table:
        total = np.zeros(SLOT_BLOCK, "<i8")
        for x in tab.column("n").to_pylist():
            total += unpack_counts(x)
        return pa.table({"block": tab.column("block")[:1], "n": pa.array([total.tobytes()], pa.binary())})

    n = np.zeros((1 << SLOT_BITS) // SLOT_BLOCK * SLOT_BLOCK, np.int64).reshape(-1, SLOT_BLOCK)
    counted = docs.select(F.col(text).alias("t")).mapInArrow(count, "block int, n binary")
    for r in counted.groupBy("block").applyInArrow(add, "block int, n binary").collect():  # a sketch of fixed size
        n[r["block"]] = np.frombuffer(r["n"], "<i8")
    n = n.ravel()
    return np.minimum(255, np.floor(4 * np.log2(1 + n / max(1.0, n.mean())))).astype(np.uint8)


def incidence(docs: DataFrame, width: int, percent: int, classes: np.ndarray, doc_id: str, text: str) -> DataFrame:
    """(id, h, n, s1, s2, b0..b3, first): hash of the text, set size, signature, parity sketch and the columns of the prefix part."""

    def run(batches):
        names = ["id", "h", "n", "s1", "s2", "b0", "b1", "b2", "b3", "first"]
        for b in batches:
            for i, rows, h, ptr in shingle_slices(b.column("t"), width):
                num = np.zeros((rows, 7), np.uint64)
                firsts = []
                for r in range(rows):
                    s = np.unique(h[ptr[r] : ptr[r + 1]])
                    n = len(s)
                    num[r, 0] = n
                    if n:
                        m = mix(s)
                        num[r, 1], num[r, 2] = m.sum(dtype=np.uint64), np.bitwise_xor.reduce(m)
                        bit = np.bincount((m & np.uint64(255)).astype(np.int64), minlength=256) & 1
                        num[r, 3:7] = np.packbits(bit.astype(np.uint8), bitorder="little").view("<u8")
                        k = n - (percent * n + 99) // 100 + 1 + n // EXTRA
                        turn = np.lexsort((s, classes[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]))[:k]
                        firsts.append(signed(s[turn]))
                    else:
                        firsts.append(np.zeros(0, np.int64))
                lens = np.concatenate(([0], np.cumsum([len(f) for f in firsts])))
                lists = pa.ListArray.from_arrays(pa.array(lens.astype(np.int32)), pa.array(np.concatenate(firsts)))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, rows), b.column("h").slice(i, rows), *(pa.array(signed(np.ascontiguousarray(num[:, k]))) for k in range(7)), lists], names)

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).withColumn("h", F.xxhash64("t")).mapInArrow(run, "id long, h long, n long, s1 long, s2 long, b0 long, b1 long, b2 long, b3 long, first array<long>")


def enough(overlap: str = "overlap") -> Column:
    """Size-derived bound on the overlap count within the multiplied part."""
    return F.col(overlap) >= 1 + F.floor(F.least("a_n", "b_n") / EXTRA)


def possible(percent: int) -> Column:
    """Size bound and parity bound of a pair with columns a_*, b_*."""
    small, large, both = F.least("a_n", "b_n"), F.greatest("a_n", "b_n"), F.col("a_n") + F.col("b_n")
    apart = sum((F.bit_count(F.col(f"a_b{k}").bitwiseXOR(F.col(f"b_b{k}"))) for k in range(1, 4)), F.bit_count(F.col("a_b0").bitwiseXOR(F.col("b_b0"))))
    return (small * 100 >= large * percent) & (apart * (100 + percent) <= both * (100 - percent))


def product(own: np.ndarray, other: np.ndarray, rows: int):
    """(a, b, count) of the rows that share columns, from (column, row) entries of two sparse matrices, the other sorted by column; a tile at a time."""
    begin, end = np.searchsorted(other[:, 0], own[:, 0]), np.searchsorted(other[:, 0], own[:, 0], "right")
    turn = np.argsort(own[:, 1], kind="stable")
    row, begin, n = own[turn, 1], begin[turn], (end - begin)[turn]
    work = np.cumsum(n)
    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
    i = 0
    while i < len(starts):
        done = work[starts[i] - 1] if starts[i] else 0
        ends = np.append(starts[i + 1 :], len(row))
        k = max(1, int(np.searchsorted(work[ends - 1], done + TILE, "right")))
        part = slice(starts[i], ends[k - 1])
        entry = np.repeat(begin[part] - (work[part] - n[part] - done), n[part]) + np.arange(n[part].sum())
        key, count = np.unique(np.repeat(row[part], n[part]) * rows + other[entry, 1], return_counts=True)
        yield key // rows, key % rows, count
        i += k


def products(at: DataFrame, percent: int) -> DataFrame:
    """(a, b, a_n, b_n, overlap) of the pairs between components that could link; overlap: columns of one least row that both have.

    at: (col, lo, rep, n, comp, most, b0..b3), lo being the column's least row and most its largest component. Columns with the same
    least row are multiplied as one block, so near copies, which share many columns, are one row and not one a column. A block
    is cut by rows into groups of about GROUP entries a side; entries of a column's largest component are only on the other side.
    """
    info = ["n", *[f"b{k}" for k in range(4)]]
    sizes = at.groupBy("lo").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts"), F.greatest(F.lit(1), F.ceil(F.sum((F.col("comp") != F.col("most")).cast("long")) / GROUP)).cast("int").alias("own_parts"))
    sized = at.join(sizes, "lo")
    piece = F.xxhash64("rep")
    names = ["lo", "i", "j", "own", "col", "rep", "comp", (F.col("comp") == F.col("most")).alias("in_most"), *info]
    left = sized.where("comp <> most").withColumn("own", F.lit(True)).withColumn("i", F.pmod(piece, "own_parts").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*names)
    right = sized.withColumn("own", F.lit(False)).withColumn("j", F.pmod(piece, "parts").cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("own_parts") - 1))).select(*names)

    def multiply(tab: pa.Table) -> pa.Table:
        v = {c: tab.column(c).to_numpy() for c in ("own", "col", "rep", "comp", "in_most", *info)}
        reps, first, row = np.unique(v["rep"], return_index=True, return_inverse=True)
        n, comp = v["n"][first], v["comp"][first]
        bits = np.stack([v[f"b{k}"][first] for k in range(4)], 1).view(np.uint64)
        side, entries = v["own"], np.stack((v["col"], row), 1)
        own, turn = entries[side], np.argsort(v["col"], kind="stable")
        out = [np.zeros((0, 3), np.int64)]
        for most in (False, True):  # entries of the largest component meet all others, the others each other once
            for a, b, count in product(own, entries[turn[(~side & (v["in_most"] == most))[turn]]], len(reps)):
                small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
                ok = (comp[a] != comp[b]) & (small * 100 >= large * percent)
                if not most:
                    ok &= a < b
                a, b, count = a[ok], b[ok], count[ok]
                apart = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
                ok = apart * (100 + percent) <= (n[a] + n[b]) * (100 - percent)
                out.append(np.stack((np.minimum(a[ok], b[ok]), np.maximum(a[ok], b[ok]), count[ok]), 1))
        a, b, count = np.concatenate(out).T
        pair, at_pair = np.unique(a * len(reps) + b, return_inverse=True)
        a, b = np.divmod(pair, len(reps))
        small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        return pa.table({"a": reps[a], "b": reps[b], "a_n": small, "b_n": large, "overlap": np.bincount(at_pair, count, len(pair)).astype(np.int64)})

    return left.unionByName(right).groupBy("lo", "i", "j").applyInArrow(multiply, "a long, b long, a_n long, b_n long, overlap long")


def jaccard_components(docs: DataFrame, work: Workspace, width: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id and links, the number of verified links kept of its set."""
    classes = column_classes(docs, text, width)
    sets = work.table(incidence(docs, width, percent, classes, doc_id, text), "sets")
    info = [f"b{k}" for k in range(4)]
    first_row = F.min(F.struct("id", "h"))  # whose text stands for the set
    rows = sets.where("n > 0 and id is not null").groupBy("n", "s1", "s2").agg(first_row.alias("m"), *[F.first(c).alias(c) for c in (*info, "first")])
    # Numbered in the order of ids: near copies have later ids than their source as a rule, and a column's least row should be the source.
    rows = work.table(rows.select("m.id", "m.h", "n", "s1", "s2", *info, "first").orderBy("id", "h").withColumn("rep", F.monotonically_increasing_id()), "rows")
    light = rows.select("rep", "n", *info)
    cols = rows.select("rep", "n", F.explode("first").alias("col"))
    shared = cols.groupBy("col").agg(F.min(F.struct("rep", "n")).alias("lo"), F.max("rep").alias("hi")).where("lo.rep < hi")
    shared = work.table(shared.select("col", F.col("lo.rep").alias("lo"), F.col("lo.n").alias("lo_n")), "shared")
    hits = work.table(cols.join(shared, "col"), "hits")
    work.drop(shared)
    texts_of = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).withColumn("h", F.xxhash64("t"))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = work.table(pairs.select("a", "b"), f"pairs_{name}")
        ids = rows.select("rep", "id", "h").join(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "rep", "left_semi")
        texts = work.table(texts_of.join(ids, ["id", "h"]).groupBy("rep").agg(F.first("t").alias("t")), f"texts_{name}")
        left, right = texts.select(F.col("rep").alias("a"), F.col("t").alias("ta")), texts.select(F.col("rep").alias("b"), F.col("t").alias("tb"))
        both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

        def exact(batches):
            for b in batches:
                x, y = shingle_sets(b.column("ta"), width), shingle_sets(b.column("tb"), width)
                same = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y)], np.int64)
                size = np.array([len(p) + len(q) for p, q in zip(x, y)], np.int64) - same
                ok = pa.array(100 * same >= percent * size)
                yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])

        found = work.table(both.mapInArrow(exact, "a long, b long"), name)
        work.drop(texts)
        return found

    def side(k: str) -> DataFrame:
        return light.select(F.col("rep").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("n", *info)])

    star = hits.where("rep > lo").groupBy(F.col("lo").alias("a"), F.col("rep").alias("b"), F.col("lo_n").alias("a_n"), F.col("n").alias("b_n")).agg(F.count(F.lit(1)).alias("overlap")).where(enough()).select("a", "b")
    near = star.join(side("a"), "a").join(side("b"), "b").where(possible(percent))
    links = verified(near, "links1")
    comp = connected_components(links, work)
    at = hits.select("col", "lo", "rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    open_cols = at.groupBy("col", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("col").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("m", "comp"))["comp"].alias("most")).where("comps > 1")
    at = work.table(at.join(open_cols.select("col", "most"), "col").join(light, "rep"), "open")
    more = verified(products(at, percent).groupBy("a", "b", "a_n", "b_n").agg(F.sum("overlap").alias("overlap")).where(enough()), "links2")
    all_links = links.unionByName(more)
    comp = connected_components(all_links, work)
    degree = all_links.unionByName(all_links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("rep")).agg(F.count(F.lit(1)).alias("links"))
    group = rows.select("n", "s1", "s2", "rep", "id").join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = work.table(group.groupBy("component").agg(F.min("id").alias("least_id")), "named", release=False)
    final = group.join(named, "component").join(degree, "rep", "left").select("n", "s1", "s2", F.col("least_id").alias("component"), "links")
    out = sets.select("id", "n", "s1", "s2").join(final, ["n", "s1", "s2"], "left")
    linked = F.col("id").isNotNull() & (F.col("n") > 0)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(linked, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"), F.when(linked, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("links"))
