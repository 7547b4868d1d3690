"""Katz backoff language model: Good-Turing discounted n-gram counts with exactly normalised backoff weights.

Documents are dealt into groups by a hash of the row. Each group lists its distinct n-grams (64-bit hashes, sorted and
delta-coded) with their counts in training documents; lists of all groups meet in buckets of n-grams, where counts are added up,
and each group gets the totals of its own n-grams back, in the order of its list. So an n-gram, however frequent, travels once
from each group. The longest n-grams, which are the most, travel after the others, so that no two large exchanges lie on disk at
once. Totals are kept in a table partitioned by kind and n-gram length and are read by (group, bucket).

A context that only one group lists has all its continuations there, so that group works out its backoff weight alone. For the
others each n-gram has one group that answers for it; a group sends what its n-grams add to a context, by the context's
number among the bucket's shared n-grams (known from the exchange of the counts, so no key travels twice), and gets the weights back
that it has unkept n-grams for, which only they multiply.

P(w|h) = d_c c(hw)/c(h) where c(hw) reaches the length's least count (1 for words, `least` for longer n-grams: a model parameter; 1
keeps singletons, more leaves them to the backoff), else alpha(h) P(w|h'). d_c is Good-Turing's ratio for c up to 5, 1 beyond (also
where the counts of counts give no ratio between 0 and 1). alpha(h) spreads exactly what the kept n-grams of h leave over the
words that they do not hold; where they leave nothing, 1/(c(h)+1) is set aside. Words unseen in training share one class, which
holds what the discounted words leave. A text ends in an end token; its first word follows a begin mark.

A null or empty text is just an end token. Null ids are not held out. Without any training document each token has probability 1.
Texts are scored whole; a row that occurs twice counts twice. Ties do not occur: counts decide nothing but probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, parts_for
from tidemark.llm.hashing import LOWER, Rolling, Words, distinct, pack_counts, pack_sorted, row_runs, slices, unpack_counts, unpack_sorted

BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
TURING = 5
BEGIN_PARTS = 64


class Stream:
    """Tokens of a group of texts, each as begin, words, end; and its n-grams of any length, worked out when asked for."""

    def __init__(self, text: pa.Array):
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, off, data in slices(text, 1 << 18):
            w = Words(off, LOWER[data])
            hashes.append(w.hashes())
            counts.append(np.diff(w.ptr))
        h, n = np.concatenate(hashes), np.concatenate(counts)
        docs = len(n)
        ptr = np.concatenate(([0], np.cumsum(n)))
        row = np.repeat(np.arange(docs), n)
        tok = np.empty(len(h) + 2 * docs, np.uint64)
        tok[np.arange(len(h)) + 2 * row + 1] = h
        d = np.arange(docs)
        tok[ptr[:-1] + 2 * d] = BEGIN
        tok[ptr[1:] + 2 * d + 1] = END
        self.ptr, self.tokens, self.docs = ptr + 2 * np.arange(docs + 1), tok, docs
        self.roll = Rolling(tok)
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.one: dict[int, np.ndarray] = {}  # an occurrence of each distinct n-gram
        self.around: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each occurrence: place of its last token and its row; the distinct n-grams, sorted; where each occurrence is among them."""
        if k not in self.known:
            start, row = row_runs(self.ptr, k)
            if k == 1:
                real = self.tokens[start] != BEGIN
                start, row = start[real], row[real]
            key, one, at = distinct(self.roll.of(start, k))
            self.one[k] = one.astype(np.int32)
            self.known[k] = (start + k - 1).astype(np.int32), row.astype(np.int32), key, at.astype(np.int32)
        return self.known[k]

    def contexts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each occurrence of length k: the place of its context among the keys of length k - 1, -1 for begin alone; and
        of its lower-order n-gram among the occurrences of length k - 1."""
        if k not in self.around:
            last, below = self.grams(k)[0], self.grams(k - 1)
            place = np.full(len(self.tokens) + 1, -1, np.int32)
            place[below[0]] = np.arange(len(below[0]))
            ctx = place[last - 1]
            self.around[k] = np.where(ctx >= 0, below[3][ctx], -1), place[last]
        return self.around[k]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))


def bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def discounts(counts_of: np.ndarray, least: int) -> np.ndarray:
    """d_r for r = 0..TURING; counts_of[r - 1] is the number of n-grams that occur r times."""
    d = np.ones(TURING + 1)
    n = counts_of.astype(float)
    a = (TURING + 1) * n[TURING] / n[0] if n[0] else 1.0
    for r in range(least, TURING + 1):
        if n[r - 1] and n[r] and a < 1:
            x = ((r + 1) * n[r] / (r * n[r - 1]) - a) / (1 - a)
            d[r] = x if 0 < x < 1 else 1.0
    return d


def backoff(share: np.ndarray, below: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, scale) of contexts from their kept n-grams' shares, these words' lower-order probabilities and the contexts' counts."""
    full = share >= 1 - 1e-9
    scale = np.where(full, total / (total + 1.0), 1.0)
    return (1 - scale * np.where(full, 1.0, share)) / np.maximum(1 - below, 1e-12), scale


class Model:
    """What of the model every task needs: a few numbers for each length."""

    def __init__(self, stats: dict[int, np.ndarray], order: int, least: int, train_docs: int):
        self.order, self.least, self.train_docs = order, least, train_docs
        zero = np.zeros(TURING + 3, np.int64)
        self.d = [discounts(stats.get(k, zero)[: TURING + 1], 1 if k == 1 else least) for k in range(1, order + 1)]
        one = stats.get(1, zero)
        self.tokens, self.types = int(one[-2]), int(one[-1])
        kept = self.tokens - sum((1 - self.d[0][r]) * r * int(one[r - 1]) for r in range(1, TURING + 1))
        self.shrink = 1.0 if self.tokens == 0 or kept < self.tokens - 1e-9 else self.tokens / (self.tokens + 1)
        self.unseen = 1 - self.shrink * kept / self.tokens if self.tokens else 1.0
        self.begin = (1.0, 1.0)  # alpha and scale of the begin mark

    def discounted(self, k: int, c: np.ndarray) -> np.ndarray:
        return c * np.where(c <= TURING, self.d[k - 1][np.minimum(c, TURING)], 1.0)

    def words(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.shrink * self.discounted(1, c) / max(1, self.tokens), self.unseen)


class Known:
    """A group's stream with what it has learnt of its n-grams: totals, whether it answers for them, whether others list them."""

    def __init__(self, model: Model, left: pa.Table, right: pa.Table, upto: int):
        """upto: the backoff weights of contexts shorter than this are worked out."""
        self.model, self.s = model, Stream(left.column("t"))
        o, b = right.column("ord").to_numpy(), right.column("bucket").to_numpy()
        self.rows = {k: np.flatnonzero(o == k)[np.argsort(b[o == k], kind="stable")].tolist() for k in range(-model.order, model.order + 1)}
        self.right, self.got, self.weights, self.chances = right, {}, {}, {}
        for k in range(2, upto + 1):
            self.weigh(k)

    def totals(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, owned, shared) of each of the keys of length k."""
        if k not in self.got:
            counts, owned, shared = [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, bool)]
            for i in self.rows[k]:
                counts.append(unpack_counts(self.right.column("counts")[i].as_py()))
                owned.append(bits(self.right.column("owned")[i].as_py(), len(counts[-1])))
                shared.append(bits(self.right.column("shared")[i].as_py(), len(counts[-1])))
            self.got[k] = np.concatenate(counts), np.concatenate(owned), np.concatenate(shared)
        return self.got[k]

    def context_totals(self, k: int) -> np.ndarray:
        """Counts of the contexts of n-grams of length k; begin alone is last."""
        return np.append(self.totals(k - 1)[0], self.model.train_docs)

    def shared_contexts(self, k: int) -> np.ndarray:
        count, _, shared = self.totals(k - 1)
        return np.flatnonzero(shared & (count > 0))

    def sizes(self, k: int) -> list[int]:
        """How many shared contexts each told row is about."""
        return [int.from_bytes(self.right.column("shared")[i].as_py(), "little") for i in self.rows[-k]]

    def needed(self, k: int) -> np.ndarray:
        """Of each context, begin alone last: does the group have an n-gram of length k after it that is not kept?"""
        ctx, _ = self.s.contexts(k)
        out = np.zeros(len(self.s.grams(k - 1)[2]) + 1, bool)
        out[ctx[self.s.one[k][self.totals(k)[0] < self.model.least]]] = True
        return out

    def sums(self, k: int, alone: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Of each context: the discounted counts of the kept n-grams that this group answers for, and what these words have below.

        alone: only of n-grams that no other group lists, which are all that follow a context that no other group lists."""
        ctx, lower = self.s.contexts(k)
        count, owned, shared = self.totals(k)
        mine = np.flatnonzero((~shared if alone else owned) & (count >= self.model.least))
        one = self.s.one[k][mine]
        below = self.probability(k - 1)[lower[one]]
        n = len(self.s.grams(k - 1)[2]) + 1
        ctx = ctx[one]
        ctx[ctx < 0] = n - 1
        return np.bincount(ctx, self.model.discounted(k, count[mine]), n).astype(float), np.bincount(ctx, below, n).astype(float)

    def weigh(self, k: int) -> None:
        """(alpha, scale) of the contexts of length k - 1: those of this group alone from its own sums, the others as told."""
        total = self.context_totals(k)
        alpha, scale = np.ones(len(total)), np.ones(len(total))
        mass, below = self.sums(k, alone=True)
        own = np.flatnonzero(~np.append(self.totals(k - 1)[2], True) & (mass > 0))
        alpha[own], scale[own] = backoff(mass[own] / total[own], below[own], total[own])
        told = [np.zeros(0), *(np.frombuffer(self.right.column("counts")[i].as_py(), "<f8") for i in self.rows[-k])]
        marks = [np.zeros(0, bool), *(bits(self.right.column("owned")[i].as_py(), n) for i, n in zip(self.rows[-k], self.sizes(k)))]
        at = self.shared_contexts(k)
        alpha[at[self.needed(k)[at]]] = np.concatenate(told)
        scaled = at[np.concatenate(marks)]
        scale[scaled] = total[scaled] / (total[scaled] + 1.0)
        if k == 2:
            alpha[-1], scale[-1] = self.model.begin
        self.weights[k] = alpha, scale

    def probability(self, k: int) -> np.ndarray:
        """P of each occurrence of length k, by recursion on the length; worked out once."""
        if k not in self.chances:
            at, count = self.s.grams(k)[3], self.totals(k)[0]
            if k == 1:
                self.chances[k] = self.model.words(count)[at]
            else:
                ctx, lower = self.s.contexts(k)
                alpha, scale = self.weights[k]
                value = np.where(count >= self.model.least, self.model.discounted(k, count), -1.0)[at]
                p, held = self.probability(k - 1)[lower], value >= 0
                p *= alpha[ctx]
                ctx = ctx[held]
                p[held] = scale[ctx] * value[held] / np.maximum(self.context_totals(k), 1)[ctx]
                self.chances[k] = p
        return self.chances[k]


REPLY = "kind string, ord int, g int, bucket int, counts binary, owned binary, shared binary"


def score(docs: DataFrame, trained: Column, work: Workspace, order: int = 2, least: int = 2, text: str = "text", keep: list[str] | None = None, group_mb: float = 4.0, least_groups: int = 96) -> DataFrame:
    """Train on the rows where `trained` is true and score all rows: columns keep, n_tokens, n_known, train_tokens, base_score, score.

    base_score is the sum over tokens of log10((c + 0.5) / (N + 0.5 (V + 1))): c the token's training count, N all training
    tokens, V the distinct ones.
    """
    keep = keep or ["doc_id"]
    groups = parts_for(docs.select(text), group_mb, least_groups)
    buckets = max(least_groups, groups // 4)
    src = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs[text].alias("t"), F.coalesce(trained, F.lit(False)).alias("train"))
    src = src.withColumn("g", F.pmod(F.xxhash64("k0", "t"), F.lit(groups)).cast("int"))
    kinds = {f"k{i}": docs.schema[c].dataType.simpleString() for i, c in enumerate(keep)}

    def lists_of(lengths: list[int]):
        def lists(tab: pa.Table) -> pa.Table:
            s = Stream(tab.column("t"))
            train = tab.column("train").to_numpy(zero_copy_only=False).astype(float)
            out = {"g": [], "ord": [], "bucket": [], "keys": [], "counts": []}
            g = tab.column("g")[0].as_py()
            for k in lengths:
                _, row, keys, at = s.grams(k)
                n = np.bincount(at, train[row], len(keys)).astype("<u4")
                cut = bounds(keys, buckets)
                for b in np.flatnonzero(np.diff(cut)):
                    part = slice(cut[b], cut[b + 1])
                    for c, v in zip(out, (g, k, int(b), pack_sorted(keys[part]), pack_counts(n[part]))):
                        out[c].append(v)
            if 1 in lengths:  # length 0: how many training documents
                for c, v in zip(out, (g, 0, g % buckets, b"", pack_counts(np.array([int(train.sum())])))):
                    out[c].append(v)
            return pa.table({c: pa.array(v, pa.binary() if c in ("keys", "counts") else pa.int32()) for c, v in out.items()})

        return lists

    def totals(tab: pa.Table) -> pa.Table:
        """Replies to each list; the numbers of its shared n-grams, where they are contexts of longer ones; counts of counts."""
        k, b = tab.column("ord")[0].as_py(), tab.column("bucket")[0].as_py()
        counts = [unpack_counts(x) for x in tab.column("counts").to_pylist()]
        out: list[tuple] = []
        if k == 0:
            stat = np.array([sum(int(c.sum()) for c in counts)])
        else:
            gs = tab.column("g").to_numpy()
            turn = np.argsort(gs, kind="stable")
            gs, counts, blobs = gs[turn].tolist(), [counts[i] for i in turn], tab.column("keys").to_pylist()
            cut = np.concatenate(([0], np.cumsum([len(c) for c in counts])))
            key, first, at = distinct(np.concatenate([unpack_sorted(blobs[i]) for i in turn]))
            held = np.bincount(at, minlength=len(key))
            n = np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)
            stat = np.concatenate([np.bincount(n[n <= TURING + 1], minlength=TURING + 2)[1:], [n.sum(), (n > 0).sum()]])
            owned = np.zeros(len(at), bool)
            owned[first] = True
            reply, shared = np.minimum(n, (1 << 32) - 1)[at], (held > 1)[at]
            context = (held > 1) & (n > 0)
            number = np.cumsum(context) - 1
            for g, a, z in zip(gs, cut, cut[1:]):
                out.append(("reply", k, g, b, pack_counts(reply[a:z]), np.packbits(owned[a:z]).tobytes(), np.packbits(shared[a:z]).tobytes()))
                if k < order:
                    own = at[a:z]
                    out.append(("number", k, g, b, pack_sorted(number[own[context[own]]].astype(np.uint64)), None, None))
            if k < order:
                out.append(("number", k, -1, b, pack_counts(n[context]), None, None))
        out.append(("stat", k, -1, b, stat.astype("<i8").tobytes(), None, None))
        types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({x.split()[0]: pa.array(v, t) for x, t, v in zip(REPLY.split(", "), types, zip(*out))})

    told = None
    for lengths in ([k for k in range(1, order)], [order]) if order > 1 else ([1],):
        listed = src.groupBy("g").applyInArrow(lists_of(lengths), "g int, ord int, bucket int, keys binary, counts binary")
        got = work.table(listed.groupBy("ord", "bucket").applyInArrow(totals, REPLY), f"totals{lengths[-1]}", partition_by=["kind", "ord"])
        told = got if told is None else told.unionByName(got)
    stats: dict[int, np.ndarray] = {}
    for r in told.where("kind = 'stat'").select("ord", "counts").collect():  # one short row for each bucket and length
        stats[r["ord"]] = stats.get(r["ord"], 0) + np.frombuffer(r["counts"], "<i8")
    model = Model(stats, order, least, int(stats.get(0, np.zeros(1))[0]))
    replies = told.where("kind = 'reply'").select("g", "ord", "bucket", "counts", "owned", "shared")

    def added_of(k: int):
        def added(left: pa.Table, right: pa.Table) -> pa.Table:
            """What the group's n-grams of length k add to its shared contexts: by bucket, in the order of their numbers."""
            out: dict[str, list] = {"bucket": [], "g": [], "some": [], "need": [], "mass": [], "below": []}
            if left.num_rows:
                own = Known(model, left, right, k - 1)
                mass, below = own.sums(k)
                need = own.needed(k)
                at, g = own.shared_contexts(k), left.column("g")[0].as_py()
                cut = np.searchsorted(at, bounds(own.s.grams(k - 1)[2], buckets))
                parts = [(int(b), at[cut[b] : cut[b + 1]]) for b in np.flatnonzero(np.diff(cut))]
                if k == 2:
                    parts.append((-1 - g % BEGIN_PARTS, np.array([len(mass) - 1])))
                for b, x in parts:
                    some, wanted = mass[x] > 0, need[x]
                    x = x[some]
                    for c, v in zip(out, (b, g, np.packbits(some).tobytes(), np.packbits(wanted).tobytes(), mass[x].astype("<f8").tobytes(), below[x].astype("<f8").tobytes())):
                        out[c].append(v)
            return pa.table({c: pa.array(v, pa.int32() if c in ("bucket", "g") else pa.binary()) for c, v in out.items()})

        return added

    def weights_of(k: int):
        def weights(left: pa.Table, right: pa.Table) -> pa.Table:
            """For each group: alpha of the bucket's shared contexts that it needs, which of all that it lists are scaled, and how many."""
            out: dict[str, list] = {"g": [], "ord": [], "bucket": [], "counts": [], "owned": [], "shared": []}
            b = (left if left.num_rows else right).column("bucket")[0].as_py()
            mine = {g: tuple(np.frombuffer(left.column(c)[i].as_py(), "<f8" if c in ("mass", "below") else "u1") for c in ("some", "mass", "below", "need")) for i, g in enumerate(left.column("g").to_pylist())}
            if b < 0:
                out = {"g": [-1], "ord": [-k], "bucket": [b], "counts": [np.array([sum(x[i].sum() for x in mine.values()) for i in (1, 2)], "<f8").tobytes()], "owned": [b""], "shared": [b""]}
            else:
                blobs = dict(zip(right.column("g").to_pylist(), right.column("counts").to_pylist()))
                total = unpack_counts(blobs.pop(-1))
                numbers = {g: unpack_sorted(x).astype(np.int64) for g, x in sorted(blobs.items())}
                mass, below = np.zeros(len(total)), np.zeros(len(total))
                for g, x in numbers.items():
                    if g in mine:
                        some, m, z, _ = mine[g]
                        x = x[np.unpackbits(some, count=len(x)).astype(bool)]
                        mass[x] += m
                        below[x] += z
                alpha, scale = backoff(mass / total, below, total)
                for g, x in numbers.items():
                    if g in mine:
                        need = np.unpackbits(mine[g][3], count=len(x)).astype(bool)
                        for c, v in zip(out, (g, -k, b, alpha[x[need]].astype("<f8").tobytes(), np.packbits(scale[x] < 1).tobytes(), len(x).to_bytes(4, "little"))):
                            out[c].append(v)
            return pa.table({c: pa.array(v, pa.int32() if c in ("g", "ord", "bucket") else pa.binary()) for c, v in out.items()})

        return weights

    for k in range(2, order + 1):
        sent = src.groupBy("g").cogroup(replies.where(F.col("ord") <= k).groupBy("g")).applyInArrow(added_of(k), "bucket int, g int, some binary, need binary, mass binary, below binary")
        numbers = told.where((F.col("kind") == "number") & (F.col("ord") == k - 1)).select("bucket", "g", "counts")
        back = work.table(sent.groupBy("bucket").cogroup(numbers.groupBy("bucket")).applyInArrow(weights_of(k), "g int, ord int, bucket int, counts binary, owned binary, shared binary"), f"weights{k}")
        if k == 2:
            parts = [np.frombuffer(r["counts"], "<f8") for r in back.where("g = -1").select("counts").collect()]  # BEGIN_PARTS rows at most
            if model.train_docs:
                alpha, scale = backoff(sum(x[:1] for x in parts) / model.train_docs, sum(x[1:] for x in parts), np.array([model.train_docs]))
                model.begin = float(alpha[0]), float(scale[0])
        replies = replies.unionByName(back.where("g >= 0"))

    names = [*kinds, "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = ", ".join([*(f"{c} {t}" for c, t in kinds.items()), "n_tokens long, n_known long, train_tokens long, base_score double, score double"])

    def final(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({c: pa.array([], pa.float64() if "score" in c else pa.int64() if c not in kinds else left.schema.field(c).type) for c in names})
        own = Known(model, left, right, order)
        s = own.s
        last, row, _, at = s.grams(1)
        c = own.totals(1)[0][at]
        p = own.probability(1).copy()
        place = np.full(len(s.tokens), -1, np.int64)
        place[last] = np.arange(len(last))
        for k in range(2, order + 1):  # the longest context that the token has decides
            p[place[s.grams(k)[0]]] = own.probability(k)
        base = np.log10((c + 0.5) / (model.tokens + 0.5 * (model.types + 1)))
        cols = {"n_tokens": np.bincount(row, minlength=s.docs), "n_known": np.bincount(row, c > 0, s.docs).astype(np.int64), "train_tokens": np.full(s.docs, model.tokens), "base_score": np.bincount(row, base, s.docs).astype(float), "score": np.bincount(row, np.log10(p), s.docs).astype(float)}
        return pa.table({**{c: left.column(c) for c in kinds}, **{c: pa.array(v) for c, v in cols.items()}})

    out = src.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(final, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *names[len(kinds) :])
