"""Substring dedup with prefix-partitioned suffix trees over words.

A window of 20 words can only repeat if the words at its anchor do (repeats), so suffixes are partitioned by the words at their anchor.
Equal segments are one leaf, that of the earliest place. Segments that share an anchor with unequal ones go on as pieces of text: the pieces of
a key meet in the group of its prefix, and keys are dealt into groups of a size that fits a task's memory. A group's suffix tree is built from its
suffix array (prefix doubling) and the longest common prefixes of neighbours, its internal nodes being intervals of the array. Of
the nodes of depth 20 words and more above a suffix, the deepest that also holds an earlier place is a maximal repeat: as many words as that
node is deep are removed.

Where a key has more than SPLIT unequal pieces, its prefix is lengthened to the whole window: each window goes to the group of its own words,
which is a node of the tree by itself, and only the earliest of its places stays. Equal windows are one before they are shuffled, so that a very common
passage costs a row a batch and not one for each of its surroundings.

Words are [^\\x20\\x09-\\x0D]+, unchanged. A null text has none. Earlier is a smaller id (null first), or the same document and
an earlier start. A row that occurs twice is one document here, so both copies keep the same words. Removal is judged
on the input. Texts are whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, parts_for
from tidemark.llm.hashing import Rolling, Words, flat, slices
from tidemark.llm.repeats import by_document, candidates, keyed
from tidemark.llm.suffix_merge import union_of

WINDOW, GRAM, SPLIT = 20, 6, 64


def deep_leaves(suffix: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which suffixes (rows of word numbers) lie below a node of full depth and are not the first of it in `order`.

    Rows are sorted as strings of words; longest common prefixes of neighbours give the tree's internal nodes.
    """
    wide = np.ascontiguousarray(suffix.astype(">u4"))
    key = wide.view(f"V{4 * suffix.shape[1]}").ravel()
    turn = np.argsort(key, kind="stable")
    common = np.zeros(len(turn), np.int64)
    common[1:] = (suffix[turn[1:]] == suffix[turn[:-1]]).cumprod(axis=1).sum(axis=1)
    node = np.cumsum(common < suffix.shape[1]) - 1  # leaves of one node of full depth
    first = np.full(node[-1] + 1 if len(node) else 0, np.iinfo(np.int64).max)
    np.minimum.at(first, node, order[turn])
    out = np.zeros(len(suffix), bool)
    out[turn] = order[turn] != first[node]
    return out


def suffix_array(number: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and the prefix each shares with the one before; left: words from a place to the end of its piece."""
    n = len(number)
    levels = [(number + 1).astype(np.int32)]
    while 1 << (len(levels) - 1) < left.max(initial=0):
        k, rank = 1 << (len(levels) - 1), levels[-1].astype(np.int64)
        after = np.zeros(n, np.int64)
        inside = np.flatnonzero(left > k)
        after[inside] = rank[inside + k]
        key, rank = np.unique(rank * (n + 2) + after, return_inverse=True)
        levels.append((rank + 1).astype(np.int32))
        if len(key) == n:
            break
    turn = np.argsort(levels[-1], kind="stable")
    a, b, common = turn[:-1], turn[1:], np.zeros(max(0, n - 1), np.int64)
    most = np.minimum(left[a], left[b])
    for k in range(len(levels) - 1, -1, -1):
        while True:
            at = np.flatnonzero(common < most)
            at = at[levels[k][a[at] + common[at]] == levels[k][b[at] + common[at]]]
            if not len(at):
                break
            common[at] = np.minimum(common[at] + (1 << k), most[at])
    return turn, np.concatenate((np.zeros(min(1, n), np.int64), common))


def maximal_repeats(turn: np.ndarray, common: np.ndarray, order: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, depths): of each suffix, the deepest node of at least `window` words that also holds a place earlier in `order`.

    Suffixes leave the array from the latest to the earliest; what is left beside one is earlier, and the nodes that
    it shares with its two neighbours are as deep as the common prefixes kept between them.
    """
    deep = np.flatnonzero(common >= window)
    near = np.unique(np.concatenate((deep, deep - 1)))
    if not len(near):
        return near, near
    size = len(near)
    up = np.where(np.concatenate(([False], near[1:] == near[:-1] + 1)), common[near], 0)
    up = np.where(up >= window, up, 0).tolist()  # shared with the neighbour before
    before, after = list(range(-1, size - 1)), list(range(1, size + 1))
    rank = order[turn[near]]
    out = [0] * size
    for i in np.argsort(-rank, kind="stable").tolist():
        p, q = before[i], after[i]
        x, y = up[i], up[q] if q < size else 0
        out[i] = max(x, y)
        if p >= 0:
            after[p] = q
        if q < size:
            before[q] = p
            up[q] = min(x, y)
    found = np.array(out)
    hit = found > 0
    return turn[near[hit]], found[hit]


def repeated_spans(docs: DataFrame, work: Workspace, window: int = WINDOW, gram: int = GRAM, split: int = SPLIT) -> DataFrame:
    """(id, rk, from, to): word ranges of keyed docs covered by windows that also start earlier; they may overlap."""
    found = candidates(docs, work, "words", window, gram)
    first = found.groupBy("key", "whole").agg(F.min(F.struct("id", "first", "rk", "last", "anchor")).alias("e"), F.max("several").alias("several"), F.count(F.lit(1)).alias("n"))
    first = work.table(first.select("key", "whole", "several", "n", F.col("e.id").alias("e_id"), F.col("e.first").alias("e_first"), F.col("e.rk").alias("e_rk"), F.col("e.last").alias("e_last"), F.col("e.anchor").alias("e_anchor")), "earliest")
    later = found.join(first.where("n > 1").select("key", "whole", "e_id", "e_first"), ["key", "whole"]).where("id <> e_id or first <> e_first")
    later = later.select("id", "rk", F.col("first").alias("from"), (F.col("last") + window).alias("to"))
    pieces = first.where("several").select("key", F.col("e_id").alias("id"), F.col("e_rk").alias("rk"), F.col("e_first").alias("first"), F.col("e_last").alias("last"))
    large = work.table(pieces.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > split).select("key"), "large")
    pieces = pieces.join(large.withColumn("large", F.lit(True)), "key", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    groups = parts_for(docs.select("t"), 4.0)
    with_text = docs.join(by_document(pieces, "key", "first", "last", "large"), ["id", "rk"])
    names = ["g", "id", "rk", "first", "large", "piece"]

    def deal(batches):
        """Pieces by group; of windows of large keys the earliest of the batch, and those that are not without their text."""
        for b in batches:
            ids, rks, spans = b.column("id").to_pylist(), b.column("rk").to_pylist(), b.column("spans")
            out = {c: [] for c in names}
            hashes, places, texts = [np.zeros(0, np.uint64)], [np.zeros((0, 3), np.int64)], []
            for i, off, data in slices(b.column("t")):
                w, raw = Words(off, data), data.tobytes()
                roll = None
                for r in range(len(off) - 1):
                    base = int(w.ptr[r])
                    for s in spans[i + r].as_py():
                        if s["large"]:
                            roll = roll or Rolling(w.hashes())
                            starts = np.arange(base + s["first"], base + s["last"] + 1)
                            hashes.append(roll.of(starts, window))
                            places.append(np.stack((np.full(len(starts), ids[i + r]), np.full(len(starts), rks[i + r]), starts - base), axis=1))
                            texts += [raw[x:y] for x, y in zip(w.start[starts].tolist(), w.end[starts + window - 1].tolist())]
                        else:
                            p = base + s["first"]
                            row = (s["key"] % groups, ids[i + r], rks[i + r], s["first"], False, raw[w.start[p] : w.end[base + s["last"] + window - 1]])
                            for c, v in zip(names, row):
                                out[c].append(v)
            h, at = np.concatenate(hashes), np.concatenate(places)
            turn = np.lexsort((at[:, 2], at[:, 0], h))
            new = np.ones(len(turn), bool)
            new[1:] = h[turn[1:]] != h[turn[:-1]]
            lead = turn[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(turn) else turn
            gone = (at[turn, 0] != at[lead, 0]) | (at[turn, 2] != at[lead, 2])
            for t, g, x in zip(turn.tolist(), (h[turn] % np.uint64(groups)).tolist(), gone.tolist()):
                for c, v in zip(names, (g, *at[t].tolist(), True, None if x else texts[t])):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["g"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in names[1:4]), pa.array(out["large"], pa.bool_()), pa.array(out["piece"], pa.binary())], names)

    def grow(tab: pa.Table) -> pa.Table:
        """The group's tree; returns the ranges of its repeats, without those at their earliest places."""
        tab = tab.combine_chunks()
        ids, rks, at = (tab.column(c).to_numpy() for c in ("id", "rk", "first"))
        large, told = tab.column("large").to_numpy(zero_copy_only=False), tab.column("piece").is_null().to_numpy()
        off, data = flat(tab.column("piece"))
        w = Words(off, data)
        _, number = np.unique(w.hashes(), return_inverse=True)
        gone = [np.flatnonzero(told)]
        depth = [np.full(len(gone[0]), window)]
        start = [at[gone[0]]]
        whole = np.flatnonzero(large & ~told)
        if len(whole):
            out = whole[deep_leaves(number[w.ptr[whole][:, None] + np.arange(window)], dense_rank(ids[whole], at[whole]))]
            gone.append(out)
            start.append(at[out])
            depth.append(np.full(len(out), window))
        small = np.flatnonzero(~large)
        if len(small):
            many = np.diff(w.ptr)[small]
            row = np.repeat(small, many)
            place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            left = np.repeat(many, many) - place
            turn, common = suffix_array(number[w.ptr[row] + place], left)
            order = dense_rank(ids[row], at[row] + place)
            leaf = np.flatnonzero(left >= window)  # shorter suffixes are windows of no piece
            one = leaf[np.unique(order[leaf], return_index=True)[1]]  # a place that comes in several rows is no earlier one for itself
            cut = np.flatnonzero(np.isin(turn, one))
            common = np.minimum.reduceat(np.append(common, 0), np.concatenate(([0], cut + 1)))[: len(cut)]
            p, d = maximal_repeats(turn[cut], common, order, window)
            if len(one) < len(leaf):  # the other rows of such a place lose its window
                out = np.zeros(order.max() + 1, bool)
                out[order[p]] = True
                other = np.setdiff1d(leaf[out[order[leaf]]], p)
                p, d = np.concatenate((p, other)), np.concatenate((d, np.full(len(other), window)))
            gone.append(row[p])
            start.append(at[row[p]] + place[p])
            depth.append(d)
        r, p = np.concatenate(gone), np.concatenate(start)
        return pa.table({"id": ids[r], "rk": rks[r], "from": p, "to": p + np.concatenate(depth)})

    tree = with_text.mapInArrow(deal, "g int, id long, rk long, first long, large boolean, piece binary").groupBy("g").applyInArrow(grow, "id long, rk long, from long, to long")
    return work.table(later.unionByName(tree), "spans")


def dense_rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rank of each pair (a, b) in order; equal pairs have equal ranks."""
    turn = np.lexsort((b, a))
    new = np.ones(len(turn), np.int64)
    new[1:] = (a[turn[1:]] != a[turn[:-1]]) | (b[turn[1:]] != b[turn[:-1]])
    out = np.empty(len(turn), np.int64)
    out[turn] = np.cumsum(new)
    return out


def remove_repeats(docs: DataFrame, work: Workspace, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", digest: bool = True, split: int = SPLIT) -> DataFrame:
    """Each row's doc_id, n_words, n_removed and kept_sha256, or with digest False the kept words joined by a space as `kept`."""
    src = keyed(docs, doc_id, text)
    spans = by_document(repeated_spans(src, work, window, gram, split), "from", "to")
    both = src.join(spans, ["id", "rk"], "left").select("id", "t", "spans")

    def cut(batches):
        for b in batches:
            spans = b.column("spans")
            for i, off, data in slices(b.column("t")):
                w, raw = Words(off, data), data.tobytes()
                n, gone, kept = [], [], []
                for r in range(len(off) - 1):
                    a, z = int(w.ptr[r]), int(w.ptr[r + 1])
                    keep = np.ones(z - a, bool)
                    if spans[i + r].is_valid:
                        for x, y in union_of([(s["from"], s["to"]) for s in spans[i + r].as_py()]):
                            keep[x:y] = False
                    at = a + np.flatnonzero(keep)
                    rest = b" ".join([raw[x:y] for x, y in zip(w.start[at].tolist(), w.end[at].tolist())])
                    n.append(z - a)
                    gone.append(z - a - len(at))
                    kept.append(hashlib.sha256(rest).hexdigest() if digest else rest.decode())
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, len(n)), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    out = both.mapInArrow(cut, "id long, n_words long, n_removed long, kept string")
    real = F.when(F.col("id") != F.lit(-(1 << 63)), F.col("id"))
    return out.select(real.alias(doc_id), "n_words", "n_removed", F.col("kept").alias("kept_sha256" if digest else "kept"))


