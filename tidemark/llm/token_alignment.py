"""Alignment of two tokenizers' tokens over the same bytes, by lockstep merging.

Every text is encoded by a byte-level tokenizer (A: a space and the text) and by a piece model (B: it puts the space itself), special
strings being plain text. The tokens of all documents of a slice lie one after another; a lane is a document, or a part of a long one between
two ends that both tokenizers share. One state vector holds each lane's place in A and in B. A step emits the pair of tokens
that each lane stands on (a link: their byte ranges overlap), moves the pointer whose token ends first, both where they end together (a
cut), and drops the lanes that are done; so a slice takes as many steps as its longest lane has links.

Counts of linked id pairs are sums over the whole corpus. A group of slices names its distinct pairs once, in a dictionary that
travels; documents refer to it by packed places. Pairs are added up by Spark, each pair's total and whether it is the best of its B
id go back to the groups that hold it, and there the documents' sums are made.

Nulls, empty texts and texts whose tokens do not spell a space and the text again have no tokens: zeros and an empty digest. Texts are never
cut short; memory for one text follows its own tokens, links are held for BLOCK tokens at a time. Repeated rows and ids are rows of their
own. Only the text and the columns of `keep` are read, whatever the names of others. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace

LANE, REACH = 512, 64  # tokens of a lane before a shared end is looked for, and how far
BLOCK = 1 << 19  # tokens whose links are held at once
SLICE, GROUP = 1 << 20, 16 << 20  # bytes of text of a slice and of a group
CACHE, LONGEST = 100_000, 64  # parts remembered by a worker, and the longest of them
#: Unicode's White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LOW = (1 << 32) - 1


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Below this code point the classes of letters, numbers and white space are the same in every regex library.
SETTLED = 0x250
#: The word pattern of byte-level files (a fixed value of the format).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Two:
    """Tokenizer A (a byte-level BPE file of the tokenizers library) and B (a sentencepiece model), with one memory of parts.

    A part begins at a space after a character that is no white space. White space at the end stays with the part
    before it. A's words begin where parts do, as white space only begins a word or fills it; no piece of B has a space behind another character (checked when the model is read). So parts are encoded each for itself.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        symbols = byte_symbols()
        vocabulary = self.a.get_vocab(False)
        self.text_a: list[bytes | None] = [None] * (1 + max(self.a.get_vocab(True).values()))
        for t, i in vocabulary.items():
            self.text_a[i] = bytes(symbols[c] for c in t) if all(c in symbols for c in t) else None
        self.quick = self.ranked(json.loads(self.a.to_str())["model"], vocabulary)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.text_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        if any(re.search("[^\u2581]\u2581", p) for p in pieces):
            raise ValueError("a piece of the model crosses a space")
        self.size_a, self.size_b = (np.array([len(t or b"") for t in x], np.int64) for x in (self.text_a, self.text_b))
        self.sign = digits(max(len(self.text_a), len(self.text_b)))
        self.signs = (self.sign != 0).sum(axis=1)
        other = WHITE.replace(" ", "", 1)
        self.part = re.compile(f"[{WHITE}]*[^{WHITE}]+(?:[{other}][{WHITE}]*[^{WHITE}]+)*(?:[{WHITE}]+\\Z)?|[{WHITE}]+")
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.older: dict[str, tuple[bytes, bytes] | None] = {}

    def ranked(self, model: dict, vocabulary: dict[str, int]):
        """The same merges for texts of settled characters, by rank; None where ids are not in the order of merges."""
        import tiktoken

        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [vocabulary.get(x + y) for x, y in merges]
        if None in ids or ids != sorted(ids) or len(set(ids)) < len(ids) or len(vocabulary) != len(ids) + 256 or min(ids) < 256:
            return None
        ranks = {self.text_a[i]: i for i in vocabulary.values()}
        return tiktoken.Encoding("merges", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == len(vocabulary) else None

    def encode_parts(self, parts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """For each part the ids of A and of B, little-endian 32-bit integers; None where either does not spell the part."""
        out = []
        slow = [p for p in parts if not self.quick or max(p) >= chr(SETTLED)]
        by_library = dict(zip(slow, (e.ids for e in self.a.encode_batch_fast(slow, add_special_tokens=False)))) if slow else {}
        quick, text_a, text_b = self.quick and self.quick._core_bpe.encode_ordinary, self.text_a, self.text_b
        for p, y in zip(parts, self.b.encode([p[1:] for p in parts], num_threads=1)):
            x = by_library[p] if p in by_library else quick(p)
            raw = p.encode()
            ok = None not in (said := [text_a[i] for i in x]) and b"".join(said) == raw and b"".join([text_b[i] for i in y]) == raw
            out.append((array("I", x).tobytes(), array("I", y).tobytes()) if ok else None)
        return out

    def encode(self, text: str) -> tuple[bytes, bytes] | None:
        """Ids of A and of B for a space and the text; None where either does not spell them."""
        parts = self.part.findall(" " + text)
        got = list(map(self.known.get, parts, repeat(0)))
        if 0 in got:
            missing = list(dict.fromkeys([p for p, g in zip(parts, got) if g == 0]))
            found = {p: self.older[p] for p in missing if p in self.older}
            new = [p for p in missing if p not in found]
            found.update(zip(new, self.encode_parts(new)))
            if len(self.known) >= CACHE:
                self.older, self.known = self.known, {}
            self.known.update([x for x in found.items() if len(x[0]) <= LONGEST])
            got = [found[p] if g == 0 else g for p, g in zip(parts, got)]
        if None in got:
            return None
        x, y = zip(*got)
        return b"".join(x), b"".join(y)


_models: dict[tuple[str, str], Two] = {}


def models(path_a: str, path_b: str) -> Two:
    """One pair of models per worker and paths."""
    if (path_a, path_b) not in _models:
        _models[path_a, path_b] = Two(path_a, path_b)
    return _models[path_a, path_b]


def lanes(ends_a: np.ndarray, ends_b: np.ndarray, doc_a: np.ndarray, lane: int = LANE) -> np.ndarray:
    """Places in A at which lanes end (exclusive): the documents' ends, and shared ends within documents longer than a lane.

    ends_*: byte ends of all tokens, one document after another; doc_a: the first token in A of each document, and their number.
    """
    sizes = np.diff(doc_a)
    long = np.flatnonzero(sizes > lane + REACH)
    stops = [doc_a[1:][sizes > 0]]
    if len(long):
        many = (sizes[long] - REACH - 1) // lane
        first = np.repeat(doc_a[long], many)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + 1
        seen = (first + nth * lane)[:, None] + np.arange(REACH)
        value = ends_a[seen]
        shared = ends_b[np.minimum(np.searchsorted(ends_b, value), len(ends_b) - 1)] == value
        ok = shared.any(axis=1)
        stops.append(seen[ok, shared[ok].argmax(axis=1)] + 1)
    return np.unique(np.concatenate(stops))


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, stop_a: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(links in A, in B, cuts in A, in B) of blocks of lanes, as places of tokens; a cut is the last token of a group in each."""
    stop_b = np.searchsorted(ends_b, ends_a[stop_a - 1]) + 1
    start_a, start_b = np.concatenate(([0], stop_a[:-1])), np.concatenate(([0], stop_b[:-1]))
    at = 0
    while at < len(stop_a):
        to = max(at + 1, int(np.searchsorted(stop_a, start_a[at] + BLOCK, "right")))
        a, b, end = start_a[at:to].copy(), start_b[at:to].copy(), stop_a[at:to]
        links_a, links_b, cuts_a, cuts_b = [], [], [], []
        while len(a):
            x, y = ends_a[a], ends_b[b]
            links_a.append(a)
            links_b.append(b)
            move_a, move_b = x <= y, y <= x
            same = move_a & move_b
            cuts_a.append(a[same])
            cuts_b.append(b[same])
            a, b = a + move_a, b + move_b
            live = a < end
            if not live.all():
                a, b, end = a[live], b[live], end[live]
        yield tuple(map(np.concatenate, (links_a, links_b, cuts_a, cuts_b)))
        at = to


def digits(most: int) -> np.ndarray:
    """Decimal digits of 0 to most - 1, zero bytes behind."""
    width = len(str(max(0, most - 1)))
    return np.frombuffer(b"".join(str(i).encode().ljust(width, b"\0") for i in range(most)), np.uint8).reshape(most, width)


def group_texts(two: Two, ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, doc_a: np.ndarray, doc_b: np.ndarray) -> list[bytes]:
    """For each document its groups as text: `a1,a2|b1;a3|b2,b3`."""
    na, nb = len(ids_a), len(ids_b)
    last_a, last_b = np.zeros(na + 1, np.int64), np.zeros(nb + 1, np.int64)
    last_a[cut_a + 1] = last_b[cut_b + 1] = 1
    group_a, group_b = np.cumsum(last_a)[:-1], np.cumsum(last_b)[:-1]
    place_a = np.arange(na) + np.concatenate(([0], cut_b + 1))[group_a]
    place_b = np.arange(nb) + (cut_a + 1)[group_b]
    width = two.sign.shape[1]
    out, size = np.empty((na + nb, width + 1), np.uint8), np.empty(na + nb, np.int64)
    for place, ids, last, end in ((place_a, ids_a, last_a, "|"), (place_b, ids_b, last_b, ";")):
        out[place, :width] = two.sign[ids]
        out[place, width] = np.where(last[1:] == 1, ord(end), ord(","))
        size[place] = two.signs[ids] + 1
    at_end = (doc_a[1:] + doc_b[1:])[np.diff(doc_b) > 0] - 1
    out[at_end, width] = 0
    size[at_end] -= 1
    ends = np.concatenate(([0], np.cumsum(size)))[doc_a + doc_b]
    flat = out.ravel()
    flat = flat[flat != 0].tobytes()
    return [flat[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]


def planes(x: np.ndarray) -> bytes:
    """Small numbers as planes of bytes, low ones first, so that empty high bytes lie together; the first byte tells the planes."""
    width = 1 if not len(x) or x.max() < 1 << 8 else 2 if x.max() < 1 << 16 else 4
    return bytes([width]) + x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def unplanes(blob: bytes) -> np.ndarray:
    width = blob[0]
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8, offset=1).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


class Pairs:
    """The dictionary of a group: distinct keys, their places in order of arrival, and their counts."""

    def __init__(self):
        self.keys, self.place, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Places of distinct sorted keys; new ones get the next."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        self.count[at[known]] += counts[known]
        new = keys[~known]
        if len(new):
            place = np.arange(len(new)) + len(self.keys)
            all_keys = np.concatenate((self.keys, new))
            turn = np.argsort(all_keys, kind="stable")
            self.place = np.concatenate((self.place, place))[turn]
            self.count = np.concatenate((self.count, counts[~known]))[turn]
            self.keys = all_keys[turn]
        return self.place[np.searchsorted(self.keys, keys)]


def counted(x: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often (or with which weight) each occurs."""
    if weight is None:
        x = np.sort(x)
        first = np.flatnonzero(np.diff(x, prepend=-1))
        return x[first], np.diff(np.append(first, len(x)))
    turn = np.argsort(x)
    x, weight = x[turn], weight[turn]
    first = np.flatnonzero(np.diff(x, prepend=-1))
    return x[first], np.add.reduceat(weight, first) if len(first) else weight


def align_slice(texts: list[str | None], two: Two, pairs: Pairs) -> dict[str, list]:
    """Columns of each document of a slice; its pairs go into the group's dictionary."""
    got = [two.encode(t) if t else None for t in texts]
    ids = [[g[k] if g else b"" for g in got] for k in (0, 1)]
    doc_a, doc_b = (np.concatenate(([0], np.cumsum([len(x) // 4 for x in side]))).astype(np.int64) for side in ids)
    ids_a, ids_b = (np.frombuffer(b"".join(side), "<u4").astype(np.int64) for side in ids)
    ends_a, ends_b = np.cumsum(two.size_a[ids_a]), np.cumsum(two.size_b[ids_b])
    n, span = len(texts), len(two.text_a) * len(two.text_b)
    doc_of = np.repeat(np.arange(n), np.diff(doc_a))
    n_links, parts, cut_a, cut_b = np.zeros(n, np.int64), [], [], []
    for la, lb, ca, cb in lockstep(ends_a, ends_b, lanes(ends_a, ends_b, doc_a)) if len(ids_a) else ():
        n_links += np.bincount(doc_of[la], minlength=n)
        parts.append(counted(doc_of[la] * span + ids_a[la] * len(two.text_b) + ids_b[lb]))
        cut_a.append(ca)
        cut_b.append(cb)
    own, count = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2
    if len(parts) > 1:  # a document may lie in two blocks
        own, count = counted(own, count)
    doc, key = np.divmod(own, span)
    keys, total = counted(key, count)
    place = pairs.add(keys, total)[np.searchsorted(keys, key)]
    own = doc << 32 | place
    turn = np.argsort(own)
    doc, place, count = doc[turn], place[turn], count[turn]
    ptr = np.searchsorted(doc, np.arange(n + 1))
    gap = np.diff(place, prepend=0)
    first = ptr[:-1][ptr[:-1] < ptr[1:]]
    gap[first] = place[first]
    cut_a, cut_b = (np.sort(np.concatenate(c)) if c else np.zeros(0, np.int64) for c in (cut_a, cut_b))
    said = group_texts(two, ids_a, ids_b, cut_a, cut_b, doc_a, doc_b)
    ptr = ptr.tolist()
    return {
        "n_a": np.diff(doc_a), "n_b": np.diff(doc_b), "n_groups": np.bincount(doc_of[cut_a], minlength=n) if len(cut_a) else np.zeros(n, np.int64), "n_links": n_links,
        "groups_sha256": [hashlib.sha256(s).hexdigest() if s else "" for s in said],
        "places": [planes(gap[i:j]) for i, j in zip(ptr, ptr[1:])], "counts": [planes(count[i:j]) for i, j in zip(ptr, ptr[1:])],
    }


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def align(docs: DataFrame, work: Workspace, path_a: str, path_b: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` and n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row.

    n_best: links whose pair's corpus-wide count is the highest of their B id, ties included; count_sum: counts added over links.
    """
    keep = keep or []
    names = [f"k{i}" for i in range(len(keep))]
    kinds = [f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    schema = ", ".join(["grp long", *kinds, *(f"{c} long" for c in NUMBERS), "groups_sha256 string, places binary, counts binary, keys binary, totals binary"])
    columns = ["grp", *names, *NUMBERS, "groups_sha256", "places", "counts", "keys", "totals"]

    def run(batches):
        two, group, pairs, held = models(path_a, path_b), TaskContext.get().partitionId() << 32, Pairs(), 0
        empty = None

        def close():  # the group's dictionary: a row of its own
            turn = np.argsort(pairs.place)
            row = [pa.array([group], pa.int64()), *(pa.nulls(1, t) for t in empty), *(pa.nulls(1, pa.int64()) for _ in NUMBERS), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())]
            return pa.RecordBatch.from_arrays([*row, pa.array([pairs.keys[turn].astype("<i8").tobytes()], pa.binary()), pa.array([pairs.count[turn].astype("<i8").tobytes()], pa.binary())], columns)

        for b in batches:
            empty = [b.column(c).type for c in names]
            texts = b.column("t")
            sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            i = 0
            while i < len(texts):
                before = int(sizes[i - 1]) if i else 0
                j = max(i + 1, int(np.searchsorted(sizes, before + SLICE, "right")))
                got = align_slice(texts.slice(i, j - i).to_pylist(), two, pairs)
                none = pa.nulls(j - i, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, group)), *(b.column(c).slice(i, j - i) for c in names), *(pa.array(got[c]) for c in NUMBERS), pa.array(got["groups_sha256"], pa.string()), pa.array(got["places"], pa.binary()), pa.array(got["counts"], pa.binary()), none, none], columns)
                held += int(sizes[j - 1]) - before
                if held >= GROUP:
                    yield close()
                    group, pairs, held = group + 1, Pairs(), 0
                i = j
        if empty is not None and held:
            yield close()

    src = docs.select(*[docs[c].alias(k) for k, c in zip(names, keep)], docs[text].alias("t"))
    aligned = work.table(src.mapInArrow(run, schema), "aligned")

    def spread(batches):
        for b in batches:
            for g, keys, totals in zip(*(b.column(c).to_pylist() for c in ("grp", "keys", "totals"))):
                keys, totals = np.frombuffer(keys, "<i8"), np.frombuffer(totals, "<i8")
                for at in range(0, len(keys), 1 << 16):
                    k = keys[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), g)), pa.array(np.arange(at, at + len(k), dtype=np.int32)), pa.array(k), pa.array(totals[at : at + (1 << 16)])], ["grp", "place", "key", "n"])

    pairs = aligned.where("keys is not null").select("grp", "keys", "totals").mapInArrow(spread, "grp long, place int, key long, n long")
    n_b = len(models(path_a, path_b).text_b)
    totals = pairs.groupBy("key").agg(F.sum("n").alias("total"))
    best = F.max("total").over(Window.partitionBy(F.col("key") % n_b))  # at most as many rows as A has ids
    totals = work.table(totals.select("key", "total", (F.col("total") == best).alias("best")), "totals", release=False)
    reply = pairs.select("grp", "place", "key").join(totals, "key").select("grp", "place", "total", "best")
    rows = aligned.where("keys is null").select("grp", *names, *NUMBERS, "groups_sha256", "places", "counts")

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        total, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, bool)
        at = right.column("place").to_numpy()
        total[at], best[at] = right.column("total").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        n_best, sums = [], []
        for x, y in zip(left.column("places").to_pylist(), left.column("counts").to_pylist()):
            place, count = np.cumsum(unplanes(x)), unplanes(y)
            n_best.append(int(count[best[place]].sum()))
            sums.append(int((count * total[place]).sum()))
        return pa.table([*(left.column(c) for c in (*names, *NUMBERS)), pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()), left.column("groups_sha256")], names=[*names, *NUMBERS, "n_best", "count_sum", "groups_sha256"])

    out = rows.groupBy("grp").cogroup(reply.groupBy("grp")).applyInArrow(judge, ", ".join([*kinds, *(f"{c} long" for c in (*NUMBERS, "n_best", "count_sum")), "groups_sha256 string"]))
    return out.select(*[F.col(k).alias(c) for k, c in zip(names, keep)], *NUMBERS, "n_best", "count_sum", "groups_sha256")
