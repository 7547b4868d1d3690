"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features (words, and runs of three bytes, which see style such as marks and capitals) is
shared by all grades; ordered thresholds cut its value into grades: P(grade <= k) = logistic(threshold_k - value). It is fitted
by limited-memory quasi-Newton steps on at most `most_rows` labelled documents (a documented bound); all documents are
scored, whole. The expected grade and the probability of the highest grades serve for selection.

A null or empty text has no features; its value is 0. Rows with a null grade are not learned from. With no labels at all every
document gets even probabilities. Ties and repeated rows need no care: each row is scored by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches
from tidemark.llm.hashing import LOWER, Words, mix, slices

WORD_BITS, STYLE_BITS = 16, 14
DIM = (1 << WORD_BITS) + (1 << STYLE_BITS)
MOST_ROWS = 4000
SLICE = 1 << 18  # bytes of text whose features are held at once


def features(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, row) of each word and of each run of three bytes of a slice."""
    w = Words(off, LOWER[data])
    word = (w.hashes() >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    n = np.maximum(np.diff(off) - 2, 0)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - (np.cumsum(n) - n)[row] + off[:-1][row]
    d = data.astype(np.uint64)
    three = mix(d[at] | d[at + 1] << np.uint64(8) | d[at + 2] << np.uint64(16)) if len(at) else np.zeros(0, np.uint64)
    return word, w.doc, (1 << WORD_BITS) + (three >> np.uint64(64 - STYLE_BITS)).astype(np.int64), row


def scale(n: np.ndarray) -> np.ndarray:
    return 1 / np.sqrt(np.maximum(n, 1))


def sparse_rows(b: pa.RecordBatch):
    """Feature and value lists of each labelled document."""
    grade = b.column("grade").to_pylist()
    for i, off, data in slices(b.column("t"), SLICE):
        f, doc, g, row = features(off, data)
        rows = len(off) - 1
        ptr, gptr = np.searchsorted(doc, np.arange(rows + 1)), np.searchsorted(row, np.arange(rows + 1))
        idx, val = [], []
        for r in range(rows):
            a, na = np.unique(f[ptr[r] : ptr[r + 1]], return_counts=True)
            c, nc = np.unique(g[gptr[r] : gptr[r + 1]], return_counts=True)
            idx.append(np.concatenate((a, c)).astype(np.int32).tobytes())
            val.append(np.concatenate((na * scale(na.sum()), nc * scale(nc.sum()))).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(grade[i : i + rows], pa.int32()), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], ["grade", "idx", "val"])


class Ordinal:
    """Shared weights and ordered thresholds of grades 0 to levels - 1."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, value: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k below the highest grade, one column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - value[:, None], -40, 40)))


def fit_ordinal(ptr: np.ndarray, idx: np.ndarray, val: np.ndarray, grade: np.ndarray, levels: int, ridge: float = 2e-4, steps: int = 80) -> Ordinal:
    """Least penalised negative log likelihood; rows are idx/val[ptr[i]:ptr[i+1]]."""
    n, row = len(grade), np.repeat(np.arange(len(grade), dtype=np.int32), np.diff(ptr))

    def cuts(p):
        return np.cumsum(np.concatenate((p[DIM : DIM + 1], np.exp(p[DIM + 1 :]))))

    def loss(p):
        s = np.bincount(row, val * p[idx], n)
        edge = np.concatenate(([-40.0], cuts(p), [40.0]))
        up, down = np.clip(edge[grade + 1] - s, -40, 40), np.clip(edge[grade] - s, -40, 40)
        fu, fd = 1 / (1 + np.exp(-up)), 1 / (1 + np.exp(-down))
        mass = np.maximum(fu - fd, 1e-12)
        du, dd = fu * (1 - fu) * (grade < levels - 1) / mass, fd * (1 - fd) * (grade > 0) / mass
        ds = (du - dd) / n  # the loss's slope along each value
        by_cut = np.array([-(du[grade == k].sum() - dd[grade == k + 1].sum()) / n for k in range(levels - 1)])
        out = np.zeros(len(p))
        out[:DIM] = np.bincount(idx, val * ds[row], DIM) + ridge * p[:DIM]
        later = np.cumsum(by_cut[::-1])[::-1]
        out[DIM] = later[0]
        out[DIM + 1 :] = later[1:] * np.exp(p[DIM + 1 :])
        return -np.log(mass).mean() + ridge / 2 * (p[:DIM] ** 2).sum(), out

    share = np.clip(np.cumsum(np.bincount(grade, minlength=levels))[:-1] / n, 0.005, 0.995)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(levels - 1))
    p = np.concatenate((np.zeros(DIM), start[:1], np.log(np.maximum(np.diff(start), 1e-3))))
    f, g = loss(p)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, a = g.copy(), []
        for s, y, r in reversed(past):
            a.append(r * (s @ q))
            q -= a[-1] * y
        if past:
            s, y, r = past[-1]
            q *= 1 / (r * (y @ y))
        for (s, y, r), k in zip(past, reversed(a)):
            q += s * (k - r * (y @ q))
        slope, t = -(g @ q), 1.0 if past else 1 / max(1e-9, np.abs(g).sum())
        if slope >= 0:
            break
        while True:
            new, ng = loss(p - t * q)
            if new <= f + 1e-4 * t * slope or t < 1e-10:
                break
            t /= 2
        s, y = -t * q, ng - g
        if s @ y > 1e-12:
            past = [*past[-7:], (s, y, 1 / (s @ y))]
        done = f - new < 1e-6 * max(1, abs(f))
        p, f, g = p - t * q, new, ng
        if done:
            break
    return Ordinal(p[:DIM].astype(np.float32), cuts(p))


def fit(labelled: DataFrame, levels: int, text: str = "text", grade: str = "grade", most_rows: int = MOST_ROWS) -> Ordinal:
    """Fit on the labelled rows given, or on most_rows of them: those with the least hash of text and grade, the same ones each time."""
    bound_batches(labelled.sparkSession)
    labelled = labelled.orderBy(F.xxhash64(F.lit(72), text, grade)).limit(most_rows)
    src = labelled.where(F.col(grade).isNotNull()).select(F.col(grade).cast("int").alias("grade"), F.col(text).alias("t"))

    def run(batches):
        for b in batches:
            yield from sparse_rows(b)

    got = src.mapInArrow(run, "grade int, idx binary, val binary").toPandas()
    if not len(got):
        return Ordinal(np.zeros(DIM, np.float32), np.zeros(levels - 1))
    got = got.sort_values(["grade", "idx", "val"], kind="stable")  # the order of arrival does not matter
    grade, idx = got["grade"].to_numpy(), [np.frombuffer(x, np.int32) for x in got["idx"]]
    ptr = np.concatenate(([0], np.cumsum([len(x) for x in idx])))
    idx, val = np.concatenate(idx), np.concatenate([np.frombuffer(x, np.float32) for x in got["val"]])
    del got
    return fit_ordinal(ptr, idx, val, grade, levels)


def sample_labels(labels: DataFrame, key: str = "doc_id", most_rows: int = MOST_ROWS) -> DataFrame:
    """About most_rows labelled rows, chosen by a hash of the key: the same rows each time; all rows if there are fewer."""
    n = labels.count()
    if n <= most_rows:
        return labels
    return labels.where(F.pmod(F.xxhash64(F.lit(71), key), F.lit(1 << 30)) < int((1 << 30) * most_rows / n))


def score(docs: DataFrame, model: Ordinal, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns keep, expected_grade, p_above (array: P(grade > k) for each k) and value."""
    bound_batches(docs.sparkSession)
    keep = keep or []
    src = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs[text].alias("t"))
    schema = ", ".join([*(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "expected_grade double", "p_above array<double>", "value double"])
    cols = [f"k{i}" for i in range(len(keep))]

    def run(batches):
        for b in batches:
            value = np.zeros(b.num_rows)
            for i, off, data in slices(b.column("t"), SLICE):
                rows = len(off) - 1
                for f, row in (lambda x: (x[:2], x[2:]))(features(off, data)):
                    value[i : i + rows] += np.bincount(row, model.weights[f].astype(np.float64), rows) * scale(np.bincount(row, minlength=rows))
            tails = model.tails(value)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64())), pa.array(value)], [*cols, "expected_grade", "p_above", "value"])

    return src.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "expected_grade", "p_above", "value")


def graded(labels: DataFrame, quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """Grade 0: toxic; 1: poor but not toxic; 2: good. A null in either gives a null grade."""
    return labels.withColumn("grade", F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 0, 1).when((F.col(quality) == 1) & (F.col(toxic) == 0), 2).cast("int"))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Ordinal:
    """Fit grades 0 to 2 on a bounded sample of the labelled documents (doc_id, quality, toxic); ids labelled twice count twice."""
    some = sample_labels(graded(labels).where("grade is not null and doc_id is not null").select("doc_id", "grade"), most_rows=most_rows)
    # at most about most_rows rows of two numbers: a proven bound
    return fit(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), 3, most_rows=most_rows)
