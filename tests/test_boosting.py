"""Quantile boosting against a plain version of the same trees, against one line, and for leaks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.plans import boosting as B
from tidemark.plans.models import quantile_line


def at_rank(v, q):
    return np.sort(v)[max(math.ceil(q * len(v)) - 1, 0)]


def plain(x, y, z, q, rounds, depth, rate, bins, least):
    """Estimates of rows z from trees on (x, y)."""
    edges = [[at_rank(x[:, j], i / bins) for i in range(1, bins)] for j in range(x.shape[1])]
    cut = lambda a: np.array([[sum(e < v for e in edges[j]) for j, v in enumerate(r)] for r in a])
    bx, bz = cut(x), cut(z)
    f, fz = np.full(len(y), at_rank(y, q)), np.full(len(z), at_rank(y, q))
    for _ in range(rounds):
        g, nodes, nz = q - (y < f), np.zeros(len(y), int), np.zeros(len(z), int)
        for _ in range(depth):
            for node in set(nodes):
                own, best = nodes == node, (0, None)
                for j in range(x.shape[1]):
                    for c in sorted(set(bx[own, j])):
                        lo = own & (bx[:, j] <= c)
                        nl, nt = lo.sum(), own.sum()
                        if nl >= least and nt - nl >= least:
                            gain = round(g[lo].sum() ** 2 / nl + (g[own].sum() - g[lo].sum()) ** 2 / (nt - nl) - g[own].sum() ** 2 / nt, 6)
                            if gain > best[0]:
                                best = (gain, (j, c))
                go, gz = (lambda b, m: m * 2 if best[1] is None else m * 2 + (b[:, best[1][0]] > best[1][1]).astype(int)), nz == node
                nodes = np.where(own, go(bx, nodes) + 1000, nodes)
                nz = np.where(gz, go(bz, nz) + 1000, nz)
            nodes, nz = nodes - 1000, nz - 1000
        step = {n: at_rank((y - f)[nodes == n], q) for n in set(nodes)}
        f, fz = f + rate * np.array([step[n] for n in nodes]), fz + rate * np.array([step.get(n, 0.0) for n in nz])
    return fz


def table(spark, n, seed):
    g = np.random.default_rng(seed)
    x = g.uniform(-2, 2, (n, 2)).round(6)
    y = (np.abs(x[:, 0]) * 2 + g.normal(size=n) * (0.2 + (x[:, 1] > 0))).round(6)
    d = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "t long, a double, b double, y double")
    return x, y, d.withColumn("known", F.col("t") + 5)


def test_equals_plain_trees_and_beats_a_line(spark):
    x, y, d = table(spark, 500, 1)
    parts = B.folds(d, "t", "known", [300, 400])
    got = {(r.t, r.level): (r.fold, r.estimate) for r in B.quantiles(parts, ["fold"], ["a", "b"], "y", (0.1, 0.9), rounds=4, depth=2, rate=0.3, bins=8).collect()}
    assert len(got) == 400 and {k[0] for k in got} == set(range(300, 500))
    loss = lambda q, v, e: np.maximum(q * (v - e), (q - 1) * (v - e)).mean()
    for q in (0.1, 0.9):
        boosted, line = [], []
        for i, (lo, hi) in enumerate([(300, 400), (400, 500)]):
            seen = lo - 5  # known strictly before the fold
            want = plain(x[:seen], y[:seen], x[lo:hi], q, 4, 2, 0.3, 8, 20)
            assert all(got[t, q][0] == i for t in range(lo, hi))
            assert np.allclose([got[t, q][1] for t in range(lo, hi)], want, atol=1e-9)
            one = lambda a: np.column_stack([np.ones(len(a)), a])
            boosted.append(loss(q, y[lo:hi], want))
            line.append(loss(q, y[lo:hi], one(x[lo:hi]) @ quantile_line(one(x[:seen]), y[:seen], q)))
        assert sum(boosted) < sum(line)


def test_later_outcomes_do_not_leak_and_nulls(spark):
    _, _, d = table(spark, 200, 2)
    d = d.withColumn("a", F.when(F.col("t") % 9 != 0, F.col("a"))).withColumn("y", F.when(F.col("t") % 11 != 0, F.col("y")))
    run = lambda e: {(r.t, r.level): r.estimate for r in B.quantiles(B.folds(e, "t", "known", [20, 150]), ["fold"], ["a"], "y", (0.5,), rounds=2, bins=4).collect()}
    base = run(d)
    assert len(base) == 180 and all(base[t, 0.5] is None for t in range(20, 150)) and all(base[t, 0.5] is not None for t in range(150, 200))
    assert run(d.withColumn("y", F.when(F.col("known") >= 150, F.lit(99.0)).otherwise(F.col("y")))) == base
