"""Quantiles by bracket and selection against sorted lists, whatever the bound of what is sorted."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.operators import quantiles as Z
from casewright.sources.scratch import keep

RNG = random.Random(8)
#: A group with nearly all rows, one of a single value that repeats, a small one, a null key; values and weights that count for nothing.
ROWS = [("hot", RNG.choice([RNG.gauss(0, 9), float(RNG.randrange(5))]), RNG.randrange(1, 6)) for _ in range(3000)] + [("same", 2.5, 1)] * 700 + [("two", float(i % 2), 1) for i in range(600)]
ROWS += [("few", float(i), i + 1) for i in range(4)] + [(None, float(i), 2) for i in range(5)] + [("few", None, 9), ("few", float("nan"), 9), ("none", None, 1), ("hot", 1e9, 0), ("hot", -1e9, None)]


def groups(weighted):
    out = {}
    for k, v, w in ROWS:
        if v is not None and not math.isnan(v) and (not weighted or (w or 0) > 0):
            out.setdefault(k, []).append((v, w))
    return out


@pytest.mark.parametrize("most", [10, 200, 100_000])
@pytest.mark.parametrize("p", [0.5, 0.0, 0.9, 1.0])
def test_quantiles(spark, p, most):
    df = spark.createDataFrame(ROWS, "k string, v double, w int").repartition(3)
    got = {r.k: r["quantile"] for r in Z.quantile(df, ["k"], F.col("v"), keep, p, most=most).collect()}
    want = {k: float(np.quantile([v for v, _ in x], p)) for k, x in groups(False).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    if p in (0.5, 0.9):
        got = {r.k: r["quantile"] for r in Z.quantile(df, ["k"], F.col("v"), keep, p, F.col("w"), most=most).collect()}
        for k, x in groups(True).items():
            x, upto = sorted(x), 0
            for v, w in x:
                upto += w
                if upto >= p * sum(w for _, w in x) - 1e-9:
                    assert got.pop(k) == v
                    break
        assert not got


@pytest.mark.parametrize("most", [50, 100_000])
def test_spread_brier_and_entropy(spark, most):
    df = spark.createDataFrame(ROWS, "k string, v double, w int")
    got = {r.k: (r["median"], r.mad) for r in Z.spread(df, ["k"], F.col("v"), keep, most=most).collect()}
    for k, x in groups(False).items():
        values = np.array([v for v, _ in x])
        assert got[k] == pytest.approx((np.median(values), np.median(np.abs(values - np.median(values)))), abs=1e-9)
    bits = {r.k: r.entropy for r in Z.entropy(df, ["k"], F.col("w")).collect()}
    assert bits["same"] == 0 and bits["few"] == pytest.approx(np.log2(6) - 2 * 1 * np.log2(2) / 6)
    assert spark.createDataFrame([(0.5, 1), (1.0, 1), (0.25, 0)], "p double, y int").select(Z.brier(F.col("p"), F.col("y")).alias("b")).first().b == pytest.approx((0.25 + 0 + 0.0625) / 3)


def test_no_percentile_of_a_group_is_held(spark, capsys):
    df = spark.range(1000).selectExpr("1 as k", "cast(id as double) as v")
    Z.quantile(df, ["k"], F.col("v"), keep, most=10).explain("formatted")
    plan = capsys.readouterr().out
    assert "percentile(" not in plan and "median(" not in plan
