"""Places where a text may repeat: content-chosen anchors whose surroundings occur more than once.

Windows of W symbols (bytes or words) are grouped into segments that share an anchor (hashing.anchors): equal windows always have equal
anchors. An anchor's key is the hash of its k symbols, so a window can only repeat if its anchor's key does. Keys are counted
first, which leaves aside all suffixes whose distinguishing prefix is short; only segments with a repeated key go on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace
from tidemark.llm.hashing import TABLE, Words, anchors, mix, signed, slices

LEAST_ID = -(1 << 63)


def keyed(docs: DataFrame, doc_id: str, text: str, carry: list[str] | None = None) -> DataFrame:
    """id (the least number for null), rk (a hash of id and text, so that ids that occur twice do no harm), t and carried columns c0, c1 .."""
    i = F.col(doc_id).cast("long")
    return docs.select(F.coalesce(i, F.lit(LEAST_ID)).alias("id"), F.xxhash64(i, F.col(text)).alias("rk"), F.col(text).alias("t"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry or [])])


def symbols(kind: str, off: np.ndarray, data: np.ndarray):
    """Symbols and row starts of a slice: bytes, or words."""
    if kind == "bytes":
        return TABLE[data], off
    w = Words(off, data)
    return w.hashes(), w.ptr


def segments(batch: pa.RecordBatch, kind: str, window: int, k: int):
    """(rows of the batch, segments with places relative to their row, signature of the whole segment)."""
    for i, off, data in slices(batch.column("t")):
        sym, ptr = symbols(kind, off, data)
        a = anchors(sym, ptr, window, k)
        if a is not None:
            whole = a["roll"].of(a["first"], a["last"] - a["first"] + window)
            whole = mix(whole ^ (a["anchor"] - a["first"]).astype(np.uint64))
            base = ptr[a["row"]]
            yield i + a["row"], a["key"], whole, a["first"] - base, a["last"] - base, a["anchor"] - base


def candidates(docs: DataFrame, work: Workspace, kind: str, window: int, k: int) -> DataFrame:
    """(id, rk, key, whole, first, last, anchor, several): segments whose key repeats; several: its key has unequal segments."""

    def keys(batches):
        for b in batches:
            for _, key, whole, *_ in segments(b, kind, window, k):
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(signed(whole))], ["key", "whole"])

    def places(batches):
        names = ["id", "rk", "key", "whole", "first", "last", "anchor"]
        for b in batches:
            ids, rks = b.column("id").to_numpy(), b.column("rk").to_numpy()
            for row, key, whole, *at in segments(b, kind, window, k):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[row], rks[row], signed(key), signed(whole), *at)], names)

    seen = docs.select("t").mapInArrow(keys, "key long, whole long").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("lo"), F.max("whole").alias("hi"))
    again = work.table(seen.where("n > 1").select("key", (F.col("lo") != F.col("hi")).alias("several")), "keys")
    found = docs.mapInArrow(places, "id long, rk long, key long, whole long, first long, last long, anchor long").join(again, "key")
    return work.table(found.select("id", "rk", "key", "whole", "first", "last", "anchor", "several"), "segments")


def by_document(spans: DataFrame, *columns: str) -> DataFrame:
    """One row for each document with arrays of its own rows; their number is bounded by its length."""
    return spans.groupBy("id", "rk").agg(F.collect_list(F.struct(*columns)).alias("spans"))
