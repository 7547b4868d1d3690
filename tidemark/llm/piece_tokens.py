"""SentencePiece encoding and decoding of merge-type (BPE) models.

A text is cut where no piece can cross (before a run of word-boundary marks that follows another character, and around characters that no piece holds).
Each part is encoded exactly by backtracking: the longest pieces that an Aho-Corasick automaton finds are taken in turn; a
piece may follow another only if merging the two texts anew gives back just these two pieces, which the edges that meet tell; where no
piece fits, the place is remembered as failed and the piece before gives way to a shorter one. Parts that were met before come
from a bounded cache, so the work follows the number of distinct parts.

Nulls and empty texts give begin and end ids only. Texts are never cut short. Only `id` and `text` columns are read; others may
have any name.
"""

from __future__ import annotations

import hashlib
import math
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches

MARK = "▁"  # the library's sign for a space
CACHE, PAIRS = 400_000, 600_000  # parts and pairs of pieces remembered by a worker


class PieceModel:
    """A BPE model file of the sentencepiece library: its pieces and scores; the encoding and decoding are our own."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.bos, self.eos, self.unk = m.bos_id(), m.eos_id(), m.unk_id()
        self.bytes = {}
        self.rank: dict[str, tuple[float, int]] = {}
        self.text: list[bytes] = [b""] * n
        for i in range(n):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
                self.text[i] = bytes([int(p[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.rank[p] = (-m.get_score(i), i)
                self.text[i] = p.replace(MARK, " ").encode()
        self.chars = {c for p in self.rank for c in p}
        self.whole: dict[str, bool] = {}
        self.pair: dict[str, dict[str, bool]] = {}
        self.left: dict[str, list[tuple[str, float]] | None] = {}
        self.right: dict[str, list[tuple[str, float]] | None] = {}
        self.learnt = 0
        self.automaton = ahocorasick.Automaton()
        for p in self.rank:
            if len(p) == 1 or self.merge(p) == [p]:
                self.automaton.add_word(p, p)
                self.whole[p] = True
        self.automaton.make_automaton()
        self.pair = {p: {} for p in self.whole}
        self.best: dict[str, dict[str, str]] = {p: {} for p in ["", *self.whole]}
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.whole), None) for p in self.whole}
        self.id_bytes = {p: np.array([i], "<u4").tobytes() for p, (_, i) in self.rank.items()}
        self.said = {p: self.text[i] for p, (_, i) in self.rank.items()}
        self.byte_ids = [np.array([self.bytes.get(b, self.unk)], "<u4").tobytes() for b in range(256)]
        self.cache: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}  # what the cache held before it was last full
        outside = "" if "\n" in self.chars else "\n"
        self.ends = [np.array([i], "<u4").tobytes() for i in (self.bos, self.eos)]
        one = "".join(map(re.escape, sorted(self.chars)))
        self.run = re.compile(f"[{one}]+|[^{one}]+")
        self.part = re.compile(f"{MARK}*[^{MARK}{outside}]+|{MARK}+" + "|\n" * bool(outside))

    def merge(self, text: str) -> list[str]:
        """The library's rule itself, for short texts: again and again join the neighbours with the best score, leftmost first."""
        s = list(text)
        while len(s) > 1:
            best = min(((self.rank[p][0], k) for k in range(len(s) - 1) if (p := s[k] + s[k + 1]) in self.rank), default=None)
            if best is None:
                break
            s[best[1] : best[1] + 2] = [s[best[1]] + s[best[1] + 1]]
        return s

    def edge(self, p: str, right: bool) -> list[tuple[str, float]] | None:
        """The pieces at one edge of p while it is merged, each with the score of the merge that ends it; None if scores fall on the way."""
        s, out, before = list(p), [], -math.inf
        while len(s) > 1:
            score, k = min((self.rank[q][0], k) for k in range(len(s) - 1) if (q := s[k] + s[k + 1]) in self.rank)
            if score < before:
                return None
            if k == (len(s) - 2 if right else 0):
                out.append((s[-1 if right else 0], score))
            s[k : k + 2] = [s[k] + s[k + 1]]
            before = score
        return [*out, (p, math.inf)]

    def apart(self, a: str, b: str) -> bool:
        """Whether merging two pieces anew leaves them as they are, told from the edges that meet.

        Each side goes its own way until a pair across is the best there is: before the merge that ends one of its two pieces, which
        goes first where the scores are equal and it lies to the left.
        """
        for side, known, right in ((a, self.right, True), (b, self.left, False)):
            if side not in known:
                known[side] = self.edge(side, right)
        x, y = self.right[a], self.left[b]
        if x is None or y is None:
            return self.merge(a + b) == [a, b]
        rank, i, j = self.rank, 0, 0
        while True:
            (p, until_p), (q, until_q) = x[i], y[j]
            across = rank.get(p + q)
            if across is not None and across[0] < until_p and across[0] <= until_q:
                return False
            if until_p <= until_q:
                if until_p == math.inf:
                    return True
                i += 1
            else:
                j += 1

    def fits(self, a: str, b: str) -> bool:
        """Whether merging the two texts anew leaves them as they are."""
        after = self.pair[a]
        got = after.get(b)
        if got is None:
            self.learnt += 1
            got = after[b] = self.apart(a, b)
        return got

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text all of whose characters are pieces themselves."""
        out, best, find, last, at = [], self.best, self.automaton.iter_long, "", 0
        found = find(text)
        while True:
            for _, p in found:
                after = best[last]
                t = after[p] if p in after else self.longest_fit(last, p)
                if t != p:
                    break
                out.append(p)
                last = p
                at += len(p)
            else:
                return out
            if not t:
                return self.go_back(text, out)
            out.append(t)
            last = t
            at += len(t)
            found = find(text, at)

    def longest_fit(self, last: str, p: str) -> str:
        """The longest of p and its shorter pieces that may follow `last`; empty if none."""
        t = p
        while t is not None and last and not self.fits(last, t):
            t = self.shorter[t]
        self.best[last][p] = t or ""
        self.learnt += 1
        return t or ""

    def go_back(self, text: str, out: list[str]) -> list[str]:
        """Continue from pieces that fit and after which none does; places where no piece fits are remembered."""
        find, best, shorter, n = self.automaton.iter_long, self.best, self.shorter, len(text)
        failed, at = set(), sum(map(len, out))
        token = None
        while True:
            last = out[-1] if out else ""
            after = best[last]
            while token:
                token = after[token] if token in after else self.longest_fit(last, token)
                if not token or at + len(token) not in failed:
                    break
                token = shorter[token]
            if token:
                out.append(token)
                at += len(token)
                if at == n:
                    return out
                token = next(find(text, at))[1]
            else:
                failed.add(at)
                token = out.pop()
                at -= len(token)
                token = shorter[token]

    def encode_part(self, part: str) -> tuple[bytes, bytes]:
        """Ids (little-endian, 4 bytes each) of a part, and the bytes that these ids decode to."""
        if self.chars.issuperset(part):
            got = self.pieces(part)
            return b"".join([self.id_bytes[p] for p in got]), b"".join([self.said[p] for p in got])
        ids, said = [], []
        for run in self.run.findall(part):
            if run[0] in self.chars:
                got = self.pieces(run)
                ids += [self.id_bytes[p] for p in got]
                said += [self.said[p] for p in got]
            else:
                raw = run.encode()
                ids += [self.byte_ids[b] for b in raw] if self.bytes else [self.byte_ids[0]] * len(run)
                said.append(b"".join([self.text[self.bytes[b]] for b in raw]) if self.bytes else " \u2047 ".encode() * len(run))
        return b"".join(ids), b"".join(said)

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """All ids of a text, begin and end included, and the decoded text in UTF-8."""
        if not text:
            return self.ends[0] + self.ends[1], b""
        if self.learnt > PAIRS:
            self.learnt = 0
            for known in (*self.pair.values(), *self.best.values()):
                known.clear()
        parts = self.part.findall(MARK + text.replace(" ", MARK))
        got = list(map(self.cache.get, parts))
        if None in got:
            cache = self.cache
            for i, g in enumerate(got):
                if g is None:
                    part = parts[i]
                    g = got[i] = self.older.get(part) or self.encode_part(part)
                    if len(part) < 64:
                        if len(cache) >= CACHE:
                            self.older = cache
                            cache = self.cache = {}
                        cache[part] = g
        ids, said = zip(*got)
        return b"".join((self.ends[0], *ids, self.ends[1])), b"".join(said)[1:]  # the mark put before the text goes

    def decode_bytes(self, ids) -> bytes:
        return b"".join([self.text[i] for i in ids])

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(i for i in ids if i not in (self.bos, self.eos)).decode("utf-8", "replace")[1:]


def lists(ids: list[bytes]) -> pa.Array:
    """Ids as an Arrow list column."""
    ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids])))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model per worker and path."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(docs: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None, outputs=("ids", "decoded")) -> DataFrame:
    """Columns `keep` and, as asked for in outputs, ids (array of int), decoded (string), n_tokens, ids_sha256, decoded_sha256."""
    bound_batches(docs.sparkSession)
    keep = keep or []
    kinds = {"ids": "array<int>", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    src = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs[text].alias("t"))
    schema = ", ".join([*(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), *(f"{c} {kinds[c]}" for c in outputs)])
    names = [*(f"k{i}" for i in range(len(keep))), *outputs]

    def run(batches):
        m = model(model_path)
        for b in batches:
            got = {c: [] for c in outputs}
            for t in b.column("t").to_pylist():
                ids, said = m.encode(t)
                for c in outputs:
                    got[c].append(ids if c == "ids" else said.decode("utf-8", "replace") if c == "decoded" else len(ids) // 4 if c == "n_tokens" else hashlib.sha256(ids if c == "ids_sha256" else said).hexdigest())
            made = {c: lists(v) if c == "ids" else pa.array(v, pa.int64() if c == "n_tokens" else pa.string()) for c, v in got.items()}
            yield pa.RecordBatch.from_arrays([*(b.column(f"k{i}") for i in range(len(keep))), *made.values()], names)

    return src.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *outputs)


