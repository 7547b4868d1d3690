"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

Suffixes are taken at content-chosen anchors, and counts of their prefixes leave aside those that are told apart early (repeats).
The others' strings (from the first to past the last window of a segment) are sorted in runs within each task, front-coded (the
length of the prefix shared with the string before, and the rest) and exchanged; runs are dealt by a hash of the whole string,
so that a common prefix does not meet in one task. Each task merges its runs with a loser tree that keeps, for
every run, the prefix known to be shared with the last output, and compares bytes beyond it only. Equal neighbours of the
merged order are repeated segments: all their windows repeat.

What remains are windows at the edges of repeats: of segments that share an anchor with unequal ones. Windows of their distinct
strings are listed by hash, counted across tasks, and the marks sent back. All windows of a segment hold its anchor, so what
its repeated windows cover is one range. Windows are matched by 64-bit hashes here, strings by their bytes.

Texts are whole and taken as UTF-8 bytes; a null is empty; matches never cross documents. A row that occurs twice counts as two
documents. Texts shorter than the window are never touched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, parts_for
from tidemark.llm.hashing import TABLE, Rolling, flat, pack_sorted, unpack_sorted
from tidemark.llm.katz import bounds
from tidemark.llm.repeats import by_document, candidates, keyed

WINDOW, GRAM = 400, 100
RUN_BYTES = 16 << 20


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes are known."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of sorted strings: the prefix shared with the one before, and the rest."""
    shared, rest, before = [], [], b""
    for s in strings:
        h = shared_prefix(before, s)
        shared.append(h)
        rest.append(s[h:])
        before = s
    return shared, rest


class LoserTree:
    """Merges front-coded sorted runs; yields (string, prefix shared with the string before, run, place in the run)."""

    def __init__(self, runs: list[tuple[list[int], list[bytes]]]):
        self.runs = runs
        self.k = 1 << max(0, (len(runs) - 1).bit_length())
        self.place = [-1] * self.k
        self.now: list[bytes | None] = [None] * self.k
        self.known = [-1] * self.k  # shared with the last output; -1: the run has ended
        self.loser = [0] * self.k

    def advance(self, i: int) -> None:
        p = self.place[i] = self.place[i] + 1
        if i < len(self.runs) and p < len(self.runs[i][0]):
            h = self.runs[i][0][p]
            self.now[i] = (self.now[i] or b"")[:h] + self.runs[i][1][p]
            self.known[i] = h
        else:
            self.now[i], self.known[i] = None, -1

    def play(self, i: int, j: int) -> tuple[int, int]:
        """(winner, loser); bytes known to be shared are not compared."""
        known = self.known
        if known[i] != known[j]:
            return (i, j) if known[i] > known[j] else (j, i)
        h = known[i]
        if h < 0:
            return i, j
        a, b = self.now[i], self.now[j]
        h = shared_prefix(a, b, h)
        if len(a) == h or (len(b) > h and a[h] < b[h]):
            known[j] = h
            return i, j
        known[i] = h
        return j, i

    def __iter__(self):
        k, loser, known = self.k, self.loser, self.known
        for i in range(k):
            self.advance(i)
        top = list(range(k))
        node = [0] * k + top
        for n in range(k - 1, 0, -1):
            node[n], loser[n] = self.play(node[2 * n], node[2 * n + 1])
        win = node[1]
        while known[win] >= 0:
            yield self.now[win], known[win], win, self.place[win]
            self.advance(win)
            n = (win + k) >> 1
            while n:
                win, loser[n] = self.play(win, loser[n])
                n >>= 1


def spread(col: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of a column of lists of structs: where each row's entries begin and end, and the fields of all entries; a null is an empty list."""
    ends = np.concatenate(([0], np.cumsum(col.value_lengths().fill_null(0).to_numpy(), dtype=np.int64)))
    return ends, [x.to_numpy(zero_copy_only=False) for x in col.flatten().flatten()]


def unions(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the ranges, in order."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.concatenate(([True], lo[1:] > top[:-1])))
    return lo[new], top[np.append(new[1:], len(lo)) - 1]


def repeated_spans(docs: DataFrame, work: Workspace, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, rk, from, to): byte ranges of keyed docs that are covered by repeated windows; they may overlap."""
    found = candidates(docs, work, "bytes", window, gram)
    groups = parts_for(docs.select("t"), 4.0)
    with_text = docs.join(by_document(found, "first", "last", "several"), ["id", "rk"])

    def runs(batches):
        held: dict[bytes, list] = {}
        size = 0

        def out():
            strings = list(held)
            off = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
            roll = Rolling(TABLE[np.frombuffer(b"".join(strings), np.uint8)])
            g = (roll.of(off[:-1], np.diff(off)) % np.uint64(groups)).tolist()
            order = sorted(range(len(strings)), key=lambda i: (g[i], strings[i]))
            cols = {c: [] for c in ("g", "shared", "sizes", "rest", "counts", "where", "several")}
            i = 0
            while i < len(order):
                j = i
                while j < len(order) and g[order[j]] == g[order[i]]:
                    j += 1
                own = [strings[x] for x in order[i:j]]
                shared, rest = front_code(own)
                at = [held[s] for s in own]
                row = (g[order[i]], np.array(shared, "<u4").tobytes(), np.array([len(x) for x in rest], "<u4").tobytes(), b"".join(rest), np.array([len(x) for x in at], "<u4").tobytes(), np.array([y[:4] for x in at for y in x], "<i8").tobytes(), np.array([y[4] for x in at for y in x], "u1").tobytes())
                for c, v in zip(cols, row):
                    cols[c].append(v)
                i = j
            yield pa.RecordBatch.from_arrays([pa.array(cols["g"], pa.int32()), *(pa.array(v, pa.binary()) for c, v in cols.items() if c != "g")], list(cols))

        for b in batches:
            off, data = flat(b.column("t"))
            ids, rks = b.column("id").to_pylist(), b.column("rk").to_pylist()
            ends, fields = spread(b.column("spans"))
            spans = list(zip(*(x.tolist() for x in fields)))
            for r in range(b.num_rows):
                text = data[off[r] : off[r + 1]].tobytes()
                for first, last, several in spans[ends[r] : ends[r + 1]]:
                    piece = text[first : last + window]
                    held.setdefault(piece, []).append((ids[r], rks[r], first, last, several))
                    size += len(piece)
                if size > RUN_BYTES:
                    yield from out()
                    held, size = {}, 0
        if held:
            yield from out()

    def merge(tab: pa.Table) -> pa.Table:
        g, rows, runs_in, at = tab.column("g")[0].as_py(), tab.num_rows, [], []
        for r in range(rows):
            v = {c: tab.column(c)[r].as_py() for c in ("shared", "sizes", "rest", "counts", "where", "several")}
            sizes = np.concatenate(([0], np.cumsum(np.frombuffer(v["sizes"], "<u4"), dtype=np.int64))).tolist()
            runs_in.append((np.frombuffer(v["shared"], "<u4").tolist(), [v["rest"][a:b] for a, b in zip(sizes, sizes[1:])]))
            cut = np.concatenate(([0], np.cumsum(np.frombuffer(v["counts"], "<u4"), dtype=np.int64)))
            at.append((cut, np.frombuffer(v["where"], "<i8").reshape(-1, 4), np.frombuffer(v["several"], "u1")))
        out = {c: [] for c in ("id", "rk", "first", "last", "s", "alone")}
        spans: list[np.ndarray] = []

        def close(s, places):
            where = np.concatenate([at[r][1][at[r][0][p] : at[r][0][p + 1]] for r, p in places])
            r, p = places[0]
            if len(where) > 1:
                spans.append(where)
            if at[r][2][at[r][0][p]]:
                for c, v in zip(out, (*where[0].tolist(), s, len(where) == 1)):
                    out[c].append(v)

        last, places = None, []
        for s, shared, r, p in LoserTree(runs_in):
            if last is not None and shared == len(s) == len(last):
                places.append((r, p))
                continue
            if last is not None:
                close(last, places)
            last, places = s, [(r, p)]
        if last is not None:
            close(last, places)
        done = np.concatenate(spans) if spans else np.zeros((0, 4), np.int64)
        n, m = len(done), len(out["s"])
        cols = {"g": pa.array(np.full(n + m, g, np.int32))}
        for k, c in enumerate(("id", "rk", "first", "last")):
            cols[c] = pa.array(np.concatenate((done[:, k], np.array(out[c], np.int64))))
        cols["s"] = pa.array([None] * n + out["s"], pa.binary())
        cols["alone"] = pa.array([False] * n + out["alone"], pa.bool_())
        return pa.table(cols)

    kind = "g int, shared binary, sizes binary, rest binary, counts binary, where binary, several binary"
    sent = with_text.mapInArrow(runs, kind)
    merged = work.table(sent.groupBy("g").applyInArrow(merge, "g int, id long, rk long, first long, last long, s binary, alone boolean"), "merged")
    work.drop(found)
    strings = merged.where("s is not null")
    buckets = max(96, groups // 4)

    def windows(tab: pa.Table):
        """Window hashes of all strings of a group, and the string and place of each."""
        data = np.frombuffer(b"".join(tab.column("s").to_pylist()), np.uint8)
        n = pa.compute.binary_length(tab.column("s")).to_numpy().astype(np.int64)
        many = n - window + 1
        row = np.repeat(np.arange(len(n)), many)
        place = np.arange(many.sum()) - (np.cumsum(many) - many)[row]
        return Rolling(TABLE[data]).of((np.cumsum(n) - n)[row] + place, window), row, place

    def lists(tab: pa.Table) -> pa.Table:
        key, count = np.unique(windows(tab)[0], return_counts=True)
        cut = bounds(key, buckets)
        some = np.flatnonzero(np.diff(cut))
        g = tab.column("g")[0].as_py()
        return pa.table({"g": pa.array([g] * len(some), pa.int32()), "bucket": pa.array(some.astype(np.int32)), "keys": pa.array([pack_sorted(key[cut[b] : cut[b + 1]]) for b in some], pa.binary()), "twice": pa.array([np.packbits(count[cut[b] : cut[b + 1]] > 1).tobytes() for b in some], pa.binary())})

    def totals(tab: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x) for x in tab.column("keys").to_pylist()]
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(tab.column("twice").to_pylist(), keys)])
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        marks = np.bincount(at, 1 + twice, len(key))[at] > 1
        ends = np.cumsum([len(k) for k in keys])
        return pa.table({"g": tab.column("g"), "bucket": tab.column("bucket"), "marks": pa.array([np.packbits(marks[e - len(k) : e]).tobytes() for e, k in zip(ends, keys)], pa.binary())})

    def edges(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("id", "rk", "from", "to")})
        h, row, place = windows(left)
        key, at = np.unique(h, return_inverse=True)
        cut = bounds(key, buckets)
        mark = np.zeros(len(key), bool)
        for b, x in zip(right.column("bucket").to_pylist(), right.column("marks").to_pylist()):
            mark[cut[b] : cut[b + 1]] = np.unpackbits(np.frombuffer(x, np.uint8), count=cut[b + 1] - cut[b])
        hit = mark[at] & left.column("alone").to_numpy(zero_copy_only=False)[row]
        r, p = row[hit], place[hit]
        new = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(r)) - 1 if len(r) else new
        start = left.column("first").to_numpy()[r[new]]
        return pa.table({"id": left.column("id").to_numpy()[r[new]], "rk": left.column("rk").to_numpy()[r[new]], "from": start + p[new], "to": start + p[last] + window})

    listed = strings.groupBy("g").applyInArrow(lists, "g int, bucket int, keys binary, twice binary")
    marks = work.table(listed.groupBy("bucket").applyInArrow(totals, "g int, bucket int, marks binary"), "marks")
    edge = strings.groupBy("g").cogroup(marks.groupBy("g")).applyInArrow(edges, "id long, rk long, from long, to long")
    whole = merged.where("s is null").select("id", "rk", F.col("first").alias("from"), (F.col("last") + window).alias("to"))
    spans = work.table(whole.unionByName(edge), "spans")
    work.drop(merged, marks)
    return spans


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by the ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, work: Workspace, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", digest: bool = True, carry: list[str] | None = None, shorter: tuple[int, int] | None = None) -> DataFrame:
    """Each row's doc_id, columns carried along, n_bytes, n_removed, n_spans and kept_sha256, or with digest False the kept text as `kept` (bytes that are cut within a character are dropped).

    shorter: a window below `window` and its gram. n_repeated, the bytes covered by repeated windows of that length, follows then; nothing is
    removed for it. A repeated long window is made of repeated short ones, so only texts with a range of those that is long enough are searched for long ones.
    """
    carry = carry or []
    src = keyed(docs, doc_id, text, carry)
    extra = [f"c{i}" for i in range(len(carry))]
    texts = src.select("id", "rk", "t")
    if shorter:
        if shorter[0] > window:
            raise ValueError("shorter must not be above the window")
        less = repeated_spans(texts, work, *shorter)
        far = less.groupBy("id", "rk").agg((F.max("to") - F.min("from")).alias("n")).where(F.col("n") >= window)
        texts = work.table(texts.join(far, ["id", "rk"], "left_semi"), "texts")
    found = repeated_spans(texts, work, window, gram).withColumn("short", F.lit(False))
    if shorter:
        found = found.unionByName(less.withColumn("short", F.lit(True)))
    spans = by_document(found, "from", "to", "short")
    both = src.join(spans, ["id", "rk"], "left").select("id", *extra, "t", "spans")

    def cut(batches):
        for b in batches:
            off, data = flat(b.column("t"))
            size, gone, many, kept = [], [], [], []
            ends, (lo, hi, short) = spread(b.column("spans"))
            base = off[:-1] + np.arange(b.num_rows)  # the rows' places, one apart so that their ranges do not touch
            shift, short = np.repeat(base, np.diff(ends)), short.astype(bool)
            lo, hi = lo + shift, hi + shift
            x, y = unions(lo[short], hi[short])
            again = np.bincount(np.searchsorted(base, x, "right") - 1, y - x, b.num_rows).astype(np.int64)
            x, y = unions(lo[~short], hi[~short])
            cut_at, starts, stops = np.append(np.searchsorted(x, base), len(x)).tolist(), x.tolist(), y.tolist()
            for r in range(b.num_rows):
                raw, at = data[off[r] : off[r + 1]].tobytes(), int(base[r])
                own = [(starts[k] - at, stops[k] - at) for k in range(cut_at[r], cut_at[r + 1])]
                left, at = [], 0
                for x, y in own:
                    left.append(raw[at:x])
                    at = y
                left.append(raw[at:])
                rest = b"".join(left)
                size.append(len(raw))
                gone.append(len(raw) - len(rest))
                many.append(len(own))
                kept.append(hashlib.sha256(rest).hexdigest() if digest else b"".join(x.decode("utf-8", "ignore").encode() for x in left).decode())
            yield pa.RecordBatch.from_arrays([b.column("id"), *(b.column(c) for c in extra), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(many, pa.int64()), pa.array(kept, pa.string()), pa.array(again, pa.int64())], ["id", *extra, "n_bytes", "n_removed", "n_spans", "kept", "n_repeated"])

    kinds = "".join(f"{x} {docs.schema[c].dataType.simpleString()}, " for x, c in zip(extra, carry))
    out = both.mapInArrow(cut, f"id long, {kinds}n_bytes long, n_removed long, n_spans long, kept string, n_repeated long")
    real = F.when(F.col("id") != F.lit(-(1 << 63)), F.col("id"))
    return out.select(real.alias(doc_id), *[F.col(x).alias(c) for x, c in zip(extra, carry)], "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256" if digest else "kept"), *["n_repeated"] * bool(shorter))
