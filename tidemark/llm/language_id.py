"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (one to three letters, runs of anything else count as one word
boundary) of a language's labelled documents, in order of frequency. A document's own list is compared with each profile by
the out-of-place distance: the sum of rank differences, where an n-gram that the profile lacks counts as the longest
distance. Letters are Unicode's, lower-cased; an n-gram is kept as its code points themselves, so no two share an entry, in whatever script.
Counts of the labelled documents cover whole texts and all documents; they are added up in each task and then by (language, n-gram).

A null text or one without a letter gives `und` and score 0; so does every text if nothing can be learned. Ties between
languages go to the first name in order, ties between n-grams to the smaller code. A null language is not learned from; a null id is
not held out. Rows are judged by their own text: repeated rows get the same answer, long texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches

EDGE = 0x1FFFFF  # the word boundary, beyond all code points; an n-gram's code is its code points, 21 bits each
TOP = 300
HELD = 1 << 20  # n-grams gathered before a task adds them up
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str | None) -> np.ndarray | None:
    """Codes of all n-grams of a text, one for each occurrence; None if it has no letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    real = letters()[c]
    if not real.any():
        return None
    real = np.concatenate(([False], real, [False]))
    c = np.where(real, np.concatenate(([0], c, [0])), EDGE)
    c = c[np.concatenate(([True], real[1:] | real[:-1]))]
    two = c[:-1] << 21 | c[1:]
    three = two[:-1] << 21 | c[2:]
    return np.concatenate((c[c != EDGE], two, three))


def profile_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n): occurrences of each n-gram in the documents of each language."""
    src = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("t"))

    def out(held):
        for k, x in held.items():
            g, n = np.unique(np.concatenate(x), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(g), pa.string()), pa.array(g), pa.array(n)], ["lang", "gram", "n"])

    def run(batches):
        held: dict[str, list[np.ndarray]] = {}
        size = 0
        for b in batches:
            for k, t in zip(b.column("lang").to_pylist(), b.column("t").to_pylist()):
                if (g := grams(t)) is not None:
                    held.setdefault(k, []).append(g)
                    size += len(g)
                    if size >= HELD:
                        yield from out(held)
                        held, size = {}, 0
        yield from out(held)

    return src.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Profiles:
    """TOP entries for each language at most, by n-gram: gram[i] has rank rank[i] in the profile of language lang[i]."""

    def __init__(self, gram: np.ndarray, lang: np.ndarray, rank: np.ndarray):
        turn = np.argsort(gram, kind="stable")
        self.gram, self.lang, self.rank = gram[turn], lang[turn].astype(np.int32), rank[turn].astype(np.int32)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], Profiles]:
    """Languages in order and their profiles.

    Lists are cut within (language, part of the n-grams) first, so no task gets all n-grams of a language; TOP rows a language, its
    profile, reach the driver and the tasks, however many documents there are.
    """
    bound_batches(docs.sparkSession)
    order = [F.col("n").desc(), F.col("gram")]
    some = profile_counts(docs, text, lang).withColumn("r", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(*order))).where(F.col("r") <= TOP)
    top = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= TOP).select("lang", "gram", "r").toPandas()
    names = sorted(top["lang"].unique())
    number = {k: i for i, k in enumerate(names)}
    return names, Profiles(top["gram"].to_numpy(np.int64), top["lang"].map(number).to_numpy(np.int64), top["r"].to_numpy(np.int64) - 1)


def predict(docs: DataFrame, names: list[str], profiles: Profiles, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns keep, lang_pred and score: 1 less the distance as a share of the longest possible."""
    bound_batches(docs.sparkSession)
    keep = keep or []
    src = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs[text].alias("t"))
    schema = ", ".join([*(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "lang_pred string", "score double"])
    cols = [f"k{i}" for i in range(len(keep))]

    def run(batches):
        for b in batches:
            said, score = [], []
            for t in b.column("t").to_pylist():
                g = grams(t) if names else None
                if g is None:
                    said.append("und")
                    score.append(0.0)
                    continue
                own, n = np.unique(g, return_counts=True)
                own = own[np.argsort(-n, kind="stable")[:TOP]]
                a, z = np.searchsorted(profiles.gram, own), np.searchsorted(profiles.gram, own, "right")
                many = z - a
                place = np.repeat(np.arange(len(own)), many)
                at = np.arange(len(place)) + np.repeat(a - (np.cumsum(many) - many), many)
                saved = TOP - np.abs(profiles.rank[at] - place)
                far = TOP * len(own) - np.bincount(profiles.lang[at], saved, len(names))
                best = int(far.argmin())
                said.append(names[best])
                score.append(float(1 - far[best] / (TOP * len(own))))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(said, pa.string()), pa.array(score, pa.float64())], [*cols, "lang_pred", "score"])

    return src.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")
