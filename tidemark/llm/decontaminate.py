"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of three blocks of BLOCK words, one block apart. Words are weighed by TF-IDF over the benchmark's
vocabulary, with document frequencies of all passages. The latent space is that of a randomised SVD in one pass: each task multiplies its part
A of the passage matrix (rows of unit length) by a random matrix and by its own transpose, and from the sum Y = A'A Omega the driver takes
the RANK leading right singular vectors and singular values of A by Nystrom's formula (Y (Omega'Y)^-1 Y' stands for A'A); the
benchmark's rows weigh as much as all documents' together. A passage is a leak if it keeps at least VERBATIM of the benchmark
passage's words in order (their longest common subsequence), or at least PARAPHRASE of them and the answer. The answer is the
item's answer column where one is given, else the item's ANSWER rarest words.

Candidates are all pairs that the words both have, in any order, do not rule out (Overlap). No leak is lost there, however large the
benchmark; the cosine in the latent space is reported for each leak and decides nothing. With cosine False the space is not made.

The benchmark is a stated query set: it is handled in blocks of at most MOST_ITEMS passages, which bounds what each task gets, whatever
its size. Verdicts do not depend on the blocks; the reported cosine is that of the block's own latent space, in which words beyond the
first MOST_WORDS of a block's vocabulary share dimensions. Items of LEAST to PHRASE - 1 words must occur as they are, word after word;
those of fewer words than LEAST say too little and are not searched for. The tail of a long item goes with the part before it.

Null and empty texts are clean; an empty benchmark leaves all documents clean. Item ids may be null or repeat; the least matching id is
reported. Repeated rows and ids are judged each by their own text, long texts whole. Only the named columns are read; others may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches
from tidemark.llm.hashing import LOWER, Words, slices

BLOCK, PART, RANK, VERBATIM, PARAPHRASE, ANSWER, PHRASE, LEAST = 32, 48, 128, 0.8, 0.5, 3, 5, 3
MORE = 16  # columns of the random matrix beyond RANK
MOST_ITEMS, MOST_WORDS = 8192, 1 << 16


class Bench:
    """Benchmark passages of one block of items: vocabulary, word numbers, answers."""

    def __init__(self, items: list[tuple]):
        texts = [t or "" for _, t, *_ in items]
        _, off, data = next(slices(pa.array(texts, pa.large_string()), 1 << 40))
        w = Words(off, LOWER[data])
        h = w.hashes()
        self.vocab = np.unique(h)
        number = np.searchsorted(self.vocab, h)
        self.parts: list[np.ndarray] = []
        self.item: list[int] = []
        for r in range(len(texts)):
            own = number[w.ptr[r] : w.ptr[r + 1]]
            cuts = max(1, -(-len(own) // (2 * BLOCK))) if len(own) > 2 * BLOCK else 1
            step = PART if cuts > 1 else max(1, len(own))
            for s in range(0, len(own), step):
                end = s + step if len(own) - s - step >= PHRASE else len(own)
                if end - s >= LEAST:
                    self.parts.append(own[s:end])
                    self.item.append(r)
                if end == len(own):
                    break
        self.ids = [i for i, *_ in items]
        self.answers = []
        for r, x in enumerate(items):
            a = x[2] if len(x) > 2 and x[2] else None
            if a is None:
                self.answers.append(None)
            else:
                _, o, d = next(slices(pa.array([a], pa.large_string()), 1 << 40))
                ah = Words(o, LOWER[d]).hashes()
                place = np.minimum(np.searchsorted(self.vocab, ah), max(0, len(self.vocab) - 1))
                self.answers.append({int(p) if len(self.vocab) and self.vocab[p] == x else -1 for p, x in zip(place, ah)})
        self.dims = min(len(self.vocab), MOST_WORDS)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The vocabulary number of each word hash; -1 outside."""
        if not len(self.vocab):
            return np.full(len(h), -1, np.int64)
        p = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return np.where(self.vocab[p] == h, p, -1)


def blocks(bench: Bench, off: np.ndarray, data: np.ndarray):
    """Numbers of the slice's words, their block, first block of each row and the number of blocks."""
    w = Words(off, LOWER[data])
    number = bench.numbers(w.hashes())
    n = np.diff(w.ptr)
    per = -(-n // BLOCK)
    first = np.concatenate(([0], np.cumsum(per)))
    block = first[:-1][w.doc] + (np.arange(len(number)) - w.ptr[:-1][w.doc]) // BLOCK
    return number, block, first, w.ptr


class Overlap:
    """How many of each benchmark passage's words a window of three blocks holds, in any order, and how many of its answer's.

    A product of the window by word presence matrix and a word by passage table, whose entries are the word's count in the passage plus
    SHIFT where it is one of the answer: dense for the words that make most work, by lists of passages for the others.
    """

    COMMON, SHIFT, MOST_ANSWER, CELLS = 256, 4096, 2048, 1 << 22

    def __init__(self, parts: list[np.ndarray], answers: list[frozenset], words: int, often: np.ndarray):
        self.words, self.parts = words, len(parts)
        asked = [sorted(x for x in a if x >= 0)[: self.MOST_ANSWER] for a in answers]
        each = np.concatenate([*parts, *(np.array(a, np.int64) for a in asked)])
        part = np.repeat(np.tile(np.arange(self.parts), 2), [len(x) for x in (*parts, *asked)])
        value = np.repeat([1, self.SHIFT], [sum(map(len, parts)), sum(map(len, asked))])
        key, at = np.unique(each * self.parts + part, return_inverse=True)
        word, self.part = np.divmod(key, self.parts)
        self.value = np.bincount(at, value, len(key)).astype(np.float32)
        self.length = np.bincount(word, minlength=words)
        self.start = np.cumsum(self.length) - self.length
        k = min(self.COMMON, words)
        common = np.argpartition(-self.length * (1.0 + often), k - 1)[:k]
        self.place = np.full(words, -1)
        self.place[common] = np.arange(k)
        self.table = np.zeros((k, self.parts), np.float32)
        own = self.place[word] >= 0
        self.table[self.place[word[own]], self.part[own]] = self.value[own]
        sizes = np.array([len(p) for p in parts])
        self.verbatim, self.paraphrase = ((share * sizes - 1e-6).astype(np.float32) for share in (VERBATIM, PARAPHRASE))
        self.answer = np.array([len(a) for a in asked], np.float32)

    def candidates(self, number: np.ndarray, block: np.ndarray, first: np.ndarray):
        """(windows, passages) of all pairs that can be leaks, a part of the windows at a time."""
        known = number >= 0
        key = np.unique(block[known] * self.words + number[known])
        at, row = key // self.words, np.repeat(np.arange(len(first) - 1), np.diff(first))
        held = [key]
        for k in (1, 2):  # a window holds its block and the two after it in the same row
            before = at >= k
            before[before] = row[at[before] - k] == row[at[before]]
            held.append(key[before] - k * self.words)
        window, word = np.divmod(np.unique(np.concatenate(held)), self.words)
        step = max(16, min(4096, self.CELLS // self.parts))
        for s in range(0, int(first[-1]), step):
            m = min(step, int(first[-1]) - s)
            own = slice(*np.searchsorted(window, (s, s + m)))
            w, x = window[own] - s, word[own]
            place = self.place[x]
            dense = np.zeros((m, len(self.table)), np.float32)
            dense[w[place >= 0], place[place >= 0]] = 1
            got = dense @ self.table
            w, x = w[place < 0], x[place < 0]
            n = self.length[x]
            entry = np.repeat(self.start[x] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            got += np.bincount(np.repeat(w, n) * self.parts + self.part[entry], self.value[entry], m * self.parts).reshape(m, self.parts)
            said = np.floor(got / self.SHIFT)
            got -= said * self.SHIFT
            hit, j = np.nonzero((got >= self.verbatim) | (got >= self.paraphrase) & (said >= self.answer))
            yield hit + s, j


class Incidence:
    """The block by word matrix of a slice: its most frequent words as a dense part, for matrix products, the others as a list."""

    COMMON = 256

    def __init__(self, number: np.ndarray, block: np.ndarray, total: int, dims: int):
        known = number >= 0
        n, b = number[known] % dims, block[known]
        count = np.bincount(n, minlength=dims)
        k = min(self.COMMON, dims)
        self.common = np.argpartition(-count, k - 1)[:k]
        place = np.full(dims, -1)
        place[self.common] = np.arange(k)
        at = place[n]
        dense = at >= 0
        self.dense = np.bincount(b[dense] * k + at[dense], minlength=total * k).reshape(total, k).astype(np.float32)
        self.word, self.block, self.total = n[~dense], b[~dense], total

    def times(self, table: np.ndarray) -> np.ndarray:
        """The matrix times a words x k table."""
        out = self.dense @ table[self.common]
        if len(self.word):
            start = np.flatnonzero(np.concatenate(([True], self.block[1:] != self.block[:-1])))
            out[self.block[start]] += np.add.reduceat(table[self.word], start, axis=0)
        return out

    def row_sums(self, weight: np.ndarray) -> np.ndarray:
        """The sum of the weights of each block's words."""
        return self.times(weight[:, None])[:, 0]

    def add_transposed(self, y: np.ndarray, total: np.ndarray) -> None:
        """total += the transposed matrix times a blocks x k table."""
        total[self.common] += self.dense.T @ y
        if len(self.word):
            turn = np.argsort(self.word, kind="stable")
            n, z = self.word[turn], self.block[turn]
            start = np.flatnonzero(np.concatenate(([True], n[1:] != n[:-1])))
            total[n[start]] += np.add.reduceat(y[z], start, axis=0)


def add_up(df: DataFrame, column: str) -> np.ndarray:
    """The sum of equally long float64 blobs by `part`, in order of part."""

    def add(tab: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<f8") for x in tab.column(column).to_pylist())
        return pa.table({"part": tab.column("part")[:1], column: pa.array([total.tobytes()], pa.binary())})

    got = df.groupBy("part").applyInArrow(add, f"part int, {column} binary").collect()  # as large as the vocabulary, which is bounded
    return np.concatenate([np.frombuffer(r[column], "<f8") for r in sorted(got, key=lambda r: r["part"])]) if got else np.zeros(0)


def pieces(total: np.ndarray, rows_each: int, width: int):
    """A matrix as (part, blob) rows."""
    for k in range(0, len(total), rows_each):
        yield k // rows_each, np.ascontiguousarray(total[k : k + rows_each]).astype("<f8").tobytes()


def frequencies(docs: DataFrame, bench: Bench) -> tuple[np.ndarray, float]:
    """In how many blocks of all documents each vocabulary word occurs, and how many blocks there are."""

    def count(batches):
        words = len(bench.vocab)
        total = np.zeros((words + 1, 1))
        for b in batches:
            for _, off, data in slices(b.column("t")):
                number, block, first, _ = blocks(bench, off, data)
                total[-1] += first[-1]
                known = number >= 0
                once = np.unique(block[known] * words + number[known])
                total[:-1, 0] += np.bincount(once % words, minlength=words)
        out = list(pieces(total, 1024, 1))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["part", "n"])

    n = add_up(docs.mapInArrow(count, "part int, n binary"), "n")
    return (n[:-1], float(n[-1])) if len(n) else (np.zeros(len(bench.vocab)), 0.0)


def folded(weights: np.ndarray, dims: int) -> np.ndarray:
    """A weight for each latent input: of words that share one, the mean."""
    at = np.arange(len(weights)) % dims
    return np.bincount(at, weights, dims) / np.maximum(1, np.bincount(at, minlength=dims))


def nystrom(y: np.ndarray, omega: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """(leading eigenvectors, eigenvalues) of a positive matrix M from y = M omega."""
    small, turn = np.linalg.eigh((omega.T @ y + y.T @ omega) / 2)
    real = small > 1e-10 * max(small[-1], 1e-300)
    u, s, _ = np.linalg.svd(y @ (turn[:, real] / np.sqrt(small[real])), full_matrices=False)
    return u[:, :rank], s[:rank] ** 2


def latent(docs: DataFrame, bench: Bench, idf: np.ndarray, rank: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors (words x rank) and singular values of the matrix of all passages, rows of unit length.

    A row's length is the root of the summed squares of its words' weights, each occurrence for itself.
    """
    columns = min(rank + MORE, bench.dims)
    omega = np.random.Generator(np.random.PCG64(seed)).standard_normal((bench.dims, columns)).astype(np.float32)
    weighed, squares = (omega * idf[:, None]).astype(np.float32), (idf * idf).astype(np.float32)

    def multiply(batches):
        total = np.zeros((bench.dims + 1, columns))
        for b in batches:
            for _, off, data in slices(b.column("t")):
                number, block, first, _ = blocks(bench, off, data)
                part = Incidence(number, block, int(first[-1]), bench.dims)
                length = part.row_sums(squares)
                some = length > 0
                total[-1, 0] += some.sum()
                part.add_transposed(part.times(weighed) * np.where(some, 1 / np.maximum(length, 1e-12), 0)[:, None], total)
        out = list(pieces(total, 256, columns))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["part", "y"])

    y = add_up(docs.mapInArrow(multiply, "part int, y binary"), "y")
    y = y.reshape(-1, columns) if len(y) else np.zeros((bench.dims + 1, columns))
    own = np.zeros((bench.dims, columns))
    for p in bench.parts:
        p = p % bench.dims
        np.add.at(own, p, weighed[p].sum(axis=0) / max(1e-12, float(squares[p].sum())))
    both = idf[:, None] * (y[:-1] / max(1.0, y[-1, 0]) + own / len(bench.parts))  # the traces of both parts are 1
    vectors, values = nystrom(both, omega.astype(float), rank)
    return vectors, np.sqrt(values)


def common_subsequence(masks: dict[int, int], full: int, words: list[int]) -> int:
    """Length of the longest common subsequence; masks: the places of each word of the one side as bits."""
    v = full
    for x in words:
        m = masks.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return full.bit_length() - v.bit_count()


def has_run(words: list[int], part: list[int]) -> bool:
    """Whether the part's words follow each other in words."""
    n = len(part)
    return any(words[i : i + n] == part for i in range(len(words) - n + 1))


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str | None = None, rank: int = RANK, cosine: bool = True) -> DataFrame:
    """(row_key, item_id, cosine, kept): one row for each passage and benchmark passage judged a leak; row_key: the doc_id. Without cosine, it is null."""
    bound_batches(docs.sparkSession)
    total = benchmark.count()
    rounds = max(1, -(-total // MOST_ITEMS))
    src = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t"))
    out = None
    cols = [F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"), *([F.col(answer).alias("a")] if answer else [])]
    for turn in range(rounds):
        part = benchmark if rounds == 1 else benchmark.where(F.pmod(F.xxhash64(item_id, item_text), F.lit(rounds)) == turn)
        items = sorted((tuple(r) for r in part.select(*cols).collect()), key=lambda r: (r[0] is None, r[0] or "", r[1] or ""))
        found = leaks_of(src, Bench(items), docs.schema[doc_id].dataType.simpleString(), rank, cosine) if items else None
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = src.where(F.lit(False)).select("k", F.lit(None).cast("string").alias("item"), F.lit(0.0).alias("cosine"), F.lit(0.0).alias("kept"))
    kind = benchmark.schema[item_id].dataType.simpleString()
    return out.select(F.col("k").alias("row_key"), F.col("item").cast(kind).alias("item_id"), "cosine", "kept")


def leaks_of(src: DataFrame, bench: Bench, kind: str, rank: int, cosine: bool = True) -> DataFrame | None:
    if not bench.parts:
        return None
    n, total = frequencies(src.select("t"), bench)
    idf = np.log((total + 1) / (n + 0.5)).clip(0.01)
    table = own = None
    if cosine:
        inner = folded(idf, bench.dims)
        vectors, _ = latent(src.select("t"), bench, inner, rank)
        table = (vectors * inner[:, None]).astype(np.float32)
        own = np.stack([table[p % bench.dims].sum(axis=0) for p in bench.parts])
        own /= np.maximum(1e-9, np.sqrt((own * own).sum(axis=1)))[:, None]
    masks = []
    for p in bench.parts:
        m: dict[int, int] = {}
        for i, x in enumerate(p.tolist()):
            m[x] = m.get(x, 0) | 1 << i
        masks.append(m)
    sizes = [len(p) for p in bench.parts]
    answers = []
    for p, r in zip(bench.parts, bench.item):
        a = bench.answers[r]
        rare = sorted(set(p.tolist()), key=lambda x: (-idf[x], x))[:ANSWER]
        answers.append(frozenset(rare) if a is None else frozenset(a))
    ids = [bench.ids[r] for r in bench.item]
    words = len(bench.vocab)
    overlap = Overlap(bench.parts, answers, words, n)

    def search(batches):
        names = ["k", "item", "cosine", "kept"]
        for b in batches:
            keys = b.column("k")
            rows, item, near, kept = [], [], [], []
            for i, off, data in slices(b.column("t")):
                number, block, first, ptr = blocks(bench, off, data)
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for window, passage in overlap.candidates(number, block, first):
                    for p, j in zip(window.tolist(), passage.tolist()):
                        r = row[p]
                        at = ptr[r] + (p - first[r]) * BLOCK
                        held = number[at : min(at + 3 * BLOCK, ptr[r + 1])]
                        words = held.tolist()
                        if sizes[j] < PHRASE and not has_run(words, bench.parts[j].tolist()):
                            continue
                        share = common_subsequence(masks[j], (1 << sizes[j]) - 1, words) / sizes[j]
                        if share >= VERBATIM or share >= PARAPHRASE and answers[j].issubset(words):
                            rows.append(i + int(r))
                            item.append(ids[j])
                            z = None if table is None else table[held[held >= 0] % bench.dims].sum(axis=0)
                            near.append(None if z is None else float(z @ own[j] / max(1e-9, np.sqrt((z * z).sum()))))
                            kept.append(share)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), pa.array(item, pa.string()), pa.array(near, pa.float64()), pa.array(kept, pa.float64())], names)

    return src.mapInArrow(search, f"k {kind}, item string, cosine double, kept double")


def judge(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, **options) -> DataFrame:
    """One row for each row of docs: doc_id, columns keep, contaminated, item_id (of the best match, least id of equals), kept share, n_hits
    and, unless cosine is False, the greatest latent cosine of the hits, null without one.

    Rows are judged by their own text, by a hash of id and text: null ids and ids that occur twice do no harm.
    """
    row = F.xxhash64(doc_id, text)
    hits = find_leaks(docs.select(row.alias("row"), F.col(text).alias("t")), benchmark, doc_id="row", text="t", **options)
    best = hits.groupBy("row_key").agg(F.max("kept").alias("kept"), F.min(F.struct((-F.col("kept")).alias("s"), "item_id"))["item_id"].alias("item_id"), F.count(F.lit(1)).alias("n_hits"), F.max("cosine").alias("cosine"))
    names = [doc_id, *(keep or [])]
    src = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)], row.alias("row"))
    out = src.join(best.withColumnRenamed("row_key", "row"), "row", "left")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], F.col("n_hits").isNotNull().alias("contaminated"), "item_id", F.coalesce("kept", F.lit(0.0)).alias("kept"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"), *(["cosine"] if options.get("cosine", True) else []))
