"""Interval join and the exact rank test against brute force."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.operators.intervals import interval_join, with_inside
from orderlens.plans.campaign import mann_whitney


def day(n):
    return dt.date(1970, 1, 1) + dt.timedelta(days=int(n))


def test_interval_join_equals_all_pairs(spark):
    r = np.random.default_rng(1)
    spans = [(k, int(a), int(a + n)) for k, (a, n) in enumerate(zip(r.integers(-3000, 3000, 300), r.choice([0, 1, 2, 3, 7, 8, 30, 365, 2000, -1], 300)))]
    windows = spark.createDataFrame([(k, day(a), day(b)) for k, a, b in spans] + [(900, None, day(1)), (901, day(1), None)], "w int, low date, high date")
    points = [(k, int(d)) for k, d in enumerate(r.integers(-3500, 3500, 200))]
    frame = spark.createDataFrame([(k, day(d)) for k, d in points] + [(999, None)], "p int, date date")
    want = sorted((p, w) for (p, d), (w, a, b) in itertools.product(points, spans) if a <= d <= b)
    got = interval_join(frame, "date", windows, "low", "high")
    assert set(got.columns) == {"p", "date", "w", "low", "high"}
    assert sorted(map(tuple, got.select("p", "w").collect())) == want and len(want) > 1000
    inside = {p for p, _ in want}
    assert {x.p for x in interval_join(frame, "date", windows, "low", "high", "left_semi").collect()} == inside
    assert {x.p for x in interval_join(frame, "date", windows, "low", "high", "left_anti").collect()} == {p for p, _ in points} - inside | {999}
    flags = {x.p: x.inside for x in with_inside(frame, "date", windows, "low", "high", "inside").collect()}
    assert flags == {p: p in inside for p, _ in points} | {999: False}
    assert with_inside(frame, "date", windows.limit(0), "low", "high", "inside").where("not inside").count() == 201
    assert interval_join(frame, "date", windows.limit(0), "low", "high").count() == 0


def test_a_hundred_thousand_windows(spark):
    n = 100_000
    windows = spark.range(n).select("id", F.date_add(F.lit(dt.date(2000, 1, 1)), (F.col("id") * 7919 % 9000).cast("int")).alias("low"), (F.col("id") % 40).cast("int").alias("len"))
    windows = windows.withColumn("high", F.date_add("low", F.col("len"))).drop("len")
    days = spark.range(9100).select(F.date_add(F.lit(dt.date(2000, 1, 1)), F.col("id").cast("int")).alias("date"))
    got = interval_join(days, "date", windows, "low", "high")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "sequence" not in plan
    low = np.arange(n) * 7919 % 9000
    inside = np.zeros(9200, np.int64)
    np.add.at(inside, low, 1)
    np.add.at(inside, low + np.arange(n) % 40 + 1, -1)
    counts = np.cumsum(inside)[:9100]
    rows = got.groupBy("date").count().collect()
    assert {(x.date - dt.date(2000, 1, 1)).days: x["count"] for x in rows} == {d: c for d, c in enumerate(counts.tolist()) if c}


def enumerated_p(a, b):
    """Two-sided p of U by all ways to draw a's ranks."""
    n1, n = len(a), len(a) + len(b)
    u = sum(x > y for x in a for y in b)
    big = max(u, n1 * len(b) - u)
    us = [sum(c) - n1 * (n1 + 1) // 2 for c in itertools.combinations(range(1, n + 1), n1)]
    return min(1.0, 2 * sum(x >= big for x in us) / len(us)), u


@pytest.mark.parametrize("n1, n2", [(1, 1), (1, 8), (3, 3), (4, 7), (8, 8), (8, 5), (2, 12)])
def test_exact_p_of_small_groups(spark, n1, n2):
    r = np.random.default_rng(n1 * 100 + n2)
    values = r.permutation(200)[: n1 + n2].tolist()
    a, b = values[:n1], values[n1:]
    frame = spark.createDataFrame([(x, 1, 0) for x in a] + [(x, 0, 1) for x in b], "v long, na long, nb long")
    row = mann_whitney(frame).first()
    p, u = enumerated_p(a, b)
    assert row.u_stat == u and row.p_value == pytest.approx(p, rel=1e-9)


def test_ties_and_larger_groups_take_the_normal_form(spark):
    tied = spark.createDataFrame([(1, 2, 1), (2, 1, 2), (3, 1, 1)], "v long, na long, nb long")
    assert mann_whitney(tied).first().p_value > 0.5
    apart = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(100 + i, 0, 1) for i in range(20)], "v long, na long, nb long")
    assert 1e-9 < mann_whitney(apart).first().p_value < 1e-6
    none = spark.createDataFrame([(1, 3, 0)], "v long, na long, nb long")
    assert mann_whitney(none).first().p_value is None
