"""Token counts by a tokenizer that drops white space, with huge documents encoded in overlapping chunks.

A document of up to CHUNK characters is encoded whole. A longer one is cut at every multiple of CHUNK; chunk k is encoded, with offsets, from its
own start to beyond the start of chunk k + 1, and so is that overlap from the start of chunk k + 1. The two are spliced at the first
place in the overlap where both have a token boundary and which is proven stable: no token of any text crosses it, and what stands before it
cannot change the tokens behind it. Such places are before ASCII white space, which belongs to no token, and between a letter
and a full stop or comma of its script, where a run of letters ends. A seam gives the tokens before the place in the left encoding less
those in the right one; the sum over all seams and the last chunk is the count of the whole document. Where no place fits, the overlap is
widened four times, first within the text at hand, then with more of the document, up to its end, which is common to both.

Chunks are rows, dealt out over all tasks, so one huge document keeps no task waiting. Documents without a chunk boundary remember
the counts of white-space-free words; special strings hold no white space, so they are found in there by the library as in the
whole text.

Nulls and empty texts have no tokens. Repeated rows and ids are rows of their own; other columns may have any name. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace

CHUNK, MARGIN, OVERLAP = 32768, 4096, 256  # characters: of a chunk, of text behind it at hand, of the first overlap
CACHE, LONGEST = 150_000, 64  # words remembered by a worker, and the longest of them
#: Before white space; between a letter and a stop of its script. Letters and stops are those that no later mark combines with to the left.
STABLE = re.compile("(?=[ \t\n\r\x0b\x0c])|(?<=[A-Za-z])(?=[.,;:?!])|(?<=[ぁ-ゖァ-ヺ一-龥])(?=[、。，：；？！])")


class Counter:
    """A file of the tokenizers library whose words never hold white space."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        told = json.loads(self.library.to_str())
        cut = (told["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        if cut.get("behavior") != "Removed" or not cut.get("invert") or any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]):
            raise ValueError("white space may belong to tokens of this file")
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}

    def count(self, text: str) -> int:
        """Tokens of a text, word by word."""
        words = text.encode().split()  # at ASCII white space only
        got = list(map(self.known.get, words, repeat(-1)))
        if -1 not in got:
            return sum(got)
        total, missing = 0, {}
        for w, g in zip(words, got):
            if g >= 0:
                total += g
            elif w in self.older:
                total += self.older[w]
            else:
                missing[w] = missing.get(w, 0) + 1
        found = dict(zip(missing, map(len, self.library.encode_batch_fast([w.decode() for w in missing], add_special_tokens=False))))
        if len(self.known) >= CACHE:
            self.older, self.known = self.known, {}
        self.known.update([x for x in found.items() if len(x[0]) <= LONGEST])
        return total + sum(found[w] * n for w, n in missing.items())

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) characters of the tokens of a text."""
        at = np.array(self.library.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        return at[:, 0], at[:, 1]


def boundary(first: np.ndarray, last: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(no token crosses, tokens before) for each place."""
    before = np.searchsorted(first, at)
    furthest = np.concatenate(([0], np.maximum.accumulate(last))) if len(last) else np.zeros(1, np.int64)
    return furthest[before] <= at, before


def seam(counter: Counter, text: str, start: int, ends: bool, overlap: int = OVERLAP) -> int | None:
    """Tokens of the chunk text[:start] with what its seam at `start` adds or takes: the left encoding's tokens before the common place
    less the right one's; None if the text at hand ends before there is one. ends: the document ends with the text."""
    while True:
        stop = min(len(text), start + overlap)
        left, right = counter.spans(text[:stop]), counter.spans(text[start:stop])
        at = np.array([m.start() for m in STABLE.finditer(text, start + 1, stop) if m.start() < stop], np.int64)
        (ok_l, n_l), (ok_r, n_r) = boundary(*left, at), boundary(*right, at - start)
        common = np.flatnonzero(ok_l & ok_r)
        if len(common):
            return int(n_l[common[0]] - n_r[common[0]])
        if stop == len(text):
            return len(left[0]) - len(right[0]) if ends else None
        overlap *= 4


_counters: dict[str, Counter] = {}


def counter_of(path: str) -> Counter:
    """One per worker and path."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, work: Workspace, path: str, limit: int = 2048, text: str = "text", keep: list[str] | None = None, chunk: int = CHUNK, margin: int = MARGIN, overlap: int = OVERLAP) -> DataFrame:
    """Columns `keep` and n_bytes, n_tokens, over_limit (n_tokens > limit) for each row."""
    keep = keep or []
    names = [f"k{i}" for i in range(len(keep))]
    kinds = [f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    src = docs.select(*[docs[c].alias(k) for k, c in zip(names, keep)], F.coalesce(docs[text], F.lit("")).alias("t"))

    def whole(batches):
        c = counter_of(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), b.column("b"), pa.array([c.count(t) for t in b.column("t").to_pylist()], pa.int64())], [*names, "b", "n"])

    sized = src.withColumn("b", F.octet_length("t").cast("long"))
    short = sized.where(F.length("t") <= chunk).mapInArrow(whole, ", ".join([*kinds, "b long, n long"]))
    long = work.table(sized.where(F.length("t") > chunk).withColumn("row", F.monotonically_increasing_id()), "long")  # written, so the numbers stay

    def cut(batches):
        """Each chunk and what is at hand behind it: (row, k, start of the next chunk or -1, whether the document ends, text)."""
        for b in batches:
            for row, t in zip(b.column("row").to_pylist(), b.column("t").to_pylist()):
                for k, at in enumerate(range(0, len(t), chunk)):
                    after = at + chunk if at + chunk < len(t) else -1
                    stop = len(t) if after < 0 else min(len(t), after + margin)
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([k], pa.int32()), pa.array([chunk if after > 0 else -1], pa.int32()), pa.array([stop == len(t)]), pa.array([t[at:stop]], pa.string())], ["row", "k", "after", "ends", "t"])

    def count(batches):
        c = counter_of(path)
        for b in batches:
            n = [len(c.spans(t)[0]) if after < 0 else seam(c, t, after, ends, overlap) for t, after, ends in zip(*(b.column(x).to_pylist() for x in ("t", "after", "ends")))]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("k"), pa.array(n, pa.int64())], ["row", "k", "n"])

    chunks = long.select("row", "t").mapInArrow(cut, "row long, k int, after int, ends boolean, t string")
    counted = work.table(chunks.repartition("row", "k").mapInArrow(count, "row long, k int, n long"), "counted", release=False)
    done, width = [counted.where("n is not null")], margin
    while (left := counted.where("n is null").select("row", "k")).limit(1).count():
        width *= 8  # more of the document for the seams that found no place
        t = F.col("t")
        more = long.select("row", "t").join(left, "row").select("row", "k", F.lit(chunk).cast("int").alias("after"), (F.length(t) <= (F.col("k") + 1) * chunk + width).alias("ends"), t.substr(F.col("k") * chunk + 1, F.lit(chunk + width)).alias("t"))
        counted = work.table(more.repartition("row", "k").mapInArrow(count, "row long, k int, n long"), "counted", release=False)
        done.append(counted.where("n is not null"))
    sums = done[0]
    for d in done[1:]:
        sums = sums.unionByName(d)
    sums = sums.groupBy("row").agg(F.sum("n").alias("n"))
    out = short.unionByName(long.drop("t").join(sums, "row").select(*names, "b", "n"))
    return out.select(*[F.col(k).alias(c) for k, c in zip(names, keep)], F.col("b").alias("n_bytes"), F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))
