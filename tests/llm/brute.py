"""Plain versions of the text operators, for small tables only."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(b: bytes) -> bytes:
    return b.translate(bytes((c + 32 if 65 <= c <= 90 else c) for c in range(256)))


def suffix_bytes(rows, window=400):
    """rows: (doc_id, text). Byte ranges covered by windows that occur elsewhere."""
    seen = Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        seen.update(b[p : p + window] for p in range(len(b) - window + 1))
    out = {}
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if seen[b[p : p + window]] > 1:
                gone[p : p + window] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def earlier_words(rows, window=20):
    first = {}
    docs = sorted(((i, WORD.findall((t or "").encode())) for i, t in rows), key=lambda x: x[0])
    for i, w in docs:
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), (i, p))
    out = {}
    for i, w in docs:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] != (i, p):
                gone[p : p + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard(rows, width=3, percent=90):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower((t or "").encode()))
        sets[i] = {tuple(w[p : p + width]) for p in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    post = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            post[x].append(i)
    ids, links = sorted(sets), []
    by_size = sorted(ids, key=lambda i: len(sets[i]))
    for k, a in enumerate(by_size):
        if not sets[a]:
            continue
        for b in by_size[k + 1 :]:
            if len(sets[a]) * 100 < percent * len(sets[b]):
                break
            n = len(sets[a] & sets[b])
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                links.append((a, b))
    comp = components(ids, links)
    return {i: (len(sets[i]), comp[i]) for i in ids}


def cosine(rows, limit=0.95):
    good = {i: np.array(v, float) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))}
    ids = sorted(good)
    links = []
    for size in {len(v) for v in good.values()}:
        own = [i for i in ids if len(good[i]) == size]
        x = np.array([good[i] / np.abs(good[i]).max() for i in own])
        n = np.sqrt((x * x).sum(1))
        for k in range(len(own)):
            c = (x[k + 1 :] @ x[k]) / (n[k + 1 :] * n[k])
            links += [(own[k], own[k + 1 + j]) for j in np.flatnonzero(c >= limit)]
    comp, deg = components([i for i, _ in rows], links), Counter(x for p in links for x in p)
    return {i: (deg[i], comp[i]) for i, _ in rows}, links


class Katz:
    """Bigram Katz model with plain dictionaries."""

    def __init__(self, rows, least=2):
        self.one, self.two = Counter(), Counter()
        self.least, self.docs = least, 0
        self.tokens = {i: [*WORD.findall(lower((t or "").encode())), None] for i, t in rows}
        for i in self.tokens:
            if zlib.crc32(str(i).encode()) % 5 != 1:
                self.docs += 1
                w = self.tokens[i]
                self.one.update(w)
                self.two.update(zip(["^", *w], w))
        self.n = sum(self.one.values())
        self.d1, self.d2 = self.turing(self.one, 1), self.turing(self.two, least)
        kept = sum(self.disc(c, self.d1) for c in self.one.values())
        self.shrink = 1.0 if kept < self.n - 1e-9 else self.n / (self.n + 1)
        self.unseen = 1 - self.shrink * kept / self.n
        self.after = defaultdict(list)
        for (u, v), c in self.two.items():
            if c >= least:
                self.after[u].append((v, c))
        self.weights = {}
        for u, vs in self.after.items():
            total = self.total(u)
            share, below = sum(self.disc(c, self.d2) for _, c in vs) / total, sum(self.p1(v) for v, _ in vs)
            scale = 1.0 if share < 1 - 1e-9 else total / (total + 1) / share
            self.weights[u] = (scale, (1 - scale * share) / max(1 - below, 1e-12))

    def total(self, u):
        return self.docs if u == "^" else self.one[u]

    @staticmethod
    def turing(counts, least):
        n = Counter(counts.values())
        a = 6 * n[6] / n[1] if n[1] else 1.0
        d = {}
        for r in range(least, 6):
            if n[r] and n[r + 1] and a < 1:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a)
                d[r] = x if 0 < x < 1 else 1.0
        return d

    @staticmethod
    def disc(c, d):
        return c * d.get(c, 1.0)

    def p1(self, v):
        return self.shrink * self.disc(self.one[v], self.d1) / self.n if self.one[v] else self.unseen

    def p2(self, u, v):
        scale, alpha = self.weights.get(u, (1.0, 1.0))
        c = self.two[u, v]
        return scale * self.disc(c, self.d2) / self.total(u) if c >= self.least else alpha * self.p1(v)

    def scores(self):
        v = len(self.one)
        for i, w in self.tokens.items():
            base = sum(math.log10((self.one[x] + 0.5) / (self.n + 0.5 * (v + 1))) for x in w)
            yield i, (len(w), sum(self.one[x] > 0 for x in w), self.n, base, sum(math.log10(self.p2(a, b)) for a, b in zip(["^", *w], w)))


def katz_scores(rows, order, least):
    """Scores of a Katz model of any order, by recursion on plain dictionaries."""
    tokens = {i: [*WORD.findall(lower((t or "").encode())), None] for i, t in rows}
    train = [("^", *w) for i, w in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = [Counter(w[p : p + k] for w in train for p in range(k == 1, len(w) - k + 1)) for k in range(1, order + 1)]
    d = [Katz.turing(c, 1 if k == 0 else least) for k, c in enumerate(counts)]
    after = defaultdict(list)
    for k in range(1, order):
        for g, c in counts[k].items():
            if c >= least:
                after[g[:-1]].append(g)
    plain, weights = Katz(rows), {}

    def total(h):
        return len(train) if h == ("^",) else counts[len(h) - 1][h]

    def share(g):
        return Katz.disc(counts[len(g) - 1][g], d[len(g) - 1]) / total(g[:-1])

    def weight(h):
        if h not in weights:
            own = sum(share(g) for g in after[h]) if h in after else 0.0
            scale = 1.0 if own < 1 - 1e-9 else total(h) / (total(h) + 1) / own
            weights[h] = (scale, (1 - scale * own) / max(1 - sum(p(g[1:]) for g in after[h]), 1e-12)) if own else (1.0, 1.0)
        return weights[h]

    def p(g):
        if len(g) == 1:
            return plain.p1(g[0])
        scale, alpha = weight(g[:-1])
        return scale * share(g) if counts[len(g) - 1][g] >= least else alpha * p(g[1:])

    return {i: sum(math.log10(p(tuple(["^", *w][max(0, n + 2 - order) : n + 2]))) for n in range(len(w))) for i, w in tokens.items()}


def leaks(rows, items):
    """(doc, item) pairs by the definition: all windows of three blocks against all passages; items of up to 64 words.

    Of words as rare as the third rarest, all are the answer.
    """
    cut = lambda t: WORD.findall(lower((t or "").encode()))
    passages = [(i, w) for i, w in ((i, cut(t)) for i, t in items) if len(w) >= 5]
    vocab, total, seen = {x for _, w in passages for x in w}, 0, Counter()
    blocks = {d: [w[k : k + 32] for k in range(0, len(w), 32)] for d, w in ((d, cut(t)) for d, t in rows)}
    for own in blocks.values():
        total += len(own)
        for x in own:
            seen.update(vocab & set(x))
    idf = {x: max(0.01, math.log((total + 1) / (seen[x] + 0.5))) for x in vocab}
    out = set()
    for i, w in passages:
        limit = sorted((idf[x] for x in set(w)), reverse=True)[:3][-1]
        sure = {x for x in set(w) if idf[x] > limit}
        tied = {x for x in set(w) if idf[x] == limit}
        for d, own in blocks.items():
            for k in range(len(own)):
                held = [x for b in own[k : k + 3] for x in b]
                if sum(x in held for x in w) < 0.5 * len(w):
                    continue
                row = [0] * (len(held) + 1)
                for x in w:
                    last = row
                    row = [0]
                    for p, y in enumerate(held):
                        row.append(last[p] + 1 if x == y else max(row[-1], last[p + 1]))
                if row[-1] / len(w) >= 0.8 or row[-1] / len(w) >= 0.5 and sure <= set(held) and tied <= set(held):
                    out.add((d, i))
    return out
