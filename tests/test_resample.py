"""Bootstraps against plain versions that draw the same blocks."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import resample as B


def start(seed, *parts, most):
    return int(hashlib.md5("|".join(map(str, (seed, *parts))).encode()).hexdigest()[:12], 16) % most


def plain(key, v, block, draws, kind, seed):
    n = len(v)
    b = min(block, n) if kind == "circular" else block
    out = []
    for t in range(draws):
        got = []
        for j in range(-(-n // b)):
            s = start(seed, key, t, j, most=n if kind == "circular" else n - b + 1)
            got += [v[(s + i) % n] for i in range(b)]
        out.append(np.mean(got[:n]))
    return out


@pytest.mark.parametrize("kind", ["moving", "circular"])
@pytest.mark.parametrize("n, block", [(23, 5), (20, 5), (7, 7), (3, 1)])
def test_draws_equal_a_plain_version(spark, kind, n, block):
    v = [float((i * 37) % 11) for i in range(n)]
    d = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)] + [("a", 99, None)], "k string, t int, v double")
    got = [r.draw_mean for r in B.block_draws(d, ["k"], "t", "v", block, 20, kind, 3).orderBy("draw").collect()]
    assert got == pytest.approx(plain("a", v, block, 20, kind, 3))


def test_short_series_null_keys_and_no_rows(spark):
    """A series shorter than a moving block has no draws; a circular block is cut to it; a null key is a key of its own."""
    d = spark.createDataFrame([(None, 1, 2.0), (None, 2, 4.0), ("b", 1, 1.0), ("c", 1, None)], "k string, t int, v double")
    rows = {r.k: r for r in B.bootstrap_mean(d, ["k"], "t", "v", 2, 10).collect()}
    assert set(rows) == {None, "b"} and rows["b"].n_draws == 0 and rows["b"].lower is None and rows["b"].mean == 1.0
    assert rows[None].n_draws == 10 and rows[None].lower == rows[None].upper == 3.0
    assert {r.k: r.n_draws for r in B.bootstrap_mean(d, ["k"], "t", "v", 5, 10, "circular").collect()} == {None: 10, "b": 10}
    assert B.bootstrap_mean(d.where("false"), ["k"], "t", "v", 2, 10).count() == 0


def test_difference_of_means(spark):
    rows = [("a", i, 5.0 + i % 2 if i % 6 == 0 else 1.0 + i % 3 * 0.1) for i in range(60)] + [("b", i, 1.0) for i in range(5)]
    d = spark.createDataFrame(rows, "k string, t int, v double")
    got = {r.k: r for r in B.difference_of_means(d, ["k"], "t", "v", (F.col("k") == "a") & (F.col("t") % 6 == 0), 5, 50).collect()}
    assert got["a"].n_event == 10 and got["a"].p_one_sided == 0.0 and got["a"].lower > 3
    assert got["b"].n_event == 0 and got["b"].p_one_sided is None and got["b"].observed_diff is None


def test_clusters(spark):
    rows = [("a", c, float(c)) for c in range(4) for _ in range(c + 1)]
    d = spark.createDataFrame(rows, "k string, c int, v double")
    got = [r.draw_mean for r in B.cluster_draws(d, ["k"], "c", "v", 15, 2).orderBy("draw").collect()]
    for t, m in enumerate(got):
        who = [start(2, "a", t, j, most=4) for j in range(4)]
        assert m == pytest.approx(sum(c * (c + 1) for c in who) / sum(c + 1 for c in who))


def test_interval_holds_the_mean_about_as_often_as_said(spark):
    """Of 60 series of independent values, most 95 % intervals hold the true mean."""
    rng = np.random.default_rng(1)
    d = spark.createDataFrame([(k, i, float(x)) for k in range(60) for i, x in enumerate(rng.normal(10, 2, 80))], "k int, t int, v double")
    n = B.bootstrap_mean(d, ["k"], "t", "v", 1, 200, "circular").where("lower <= 10 and upper >= 10").count()
    assert 51 <= n <= 60
