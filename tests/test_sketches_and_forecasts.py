"""Sketches against exact ranks, and the ranked probability score against a double loop."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecast, scoring, sketches

D0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = [(D0 + dt.timedelta(days=i % 20), float(v), None if i % 50 == 0 else float(v) ** 2) for i, v in enumerate(rng.gamma(2, 5, 60_000))]
    return spark.createDataFrame(rows, "ts timestamp, a double, b double").cache()


def test_ranks_of_any_span_are_within_a_hundredth(spark, table):
    daily = sketches.daily_sketches(table, [], "ts", ["a", "b"]).cache()
    assert daily.count() == 40
    odds = {f"q{i}": i / 20 for i in range(1, 20)}
    for first, last in (("2024-01-01", "2024-01-20"), ("2024-01-03", "2024-01-09"), ("2024-01-05", "2024-01-05")):
        for r in sketches.profile(daily, [], first, last, odds).collect():
            own = np.sort([x[r.feature] for x in table.filter(F.to_date("ts").between(first, last)).collect() if x[r.feature] is not None])
            assert (r.n, r.least, r.greatest) == (len(own), own[0], own[-1])
            assert all(abs(np.searchsorted(own, r[name], "right") / len(own) - q) < 0.01 for name, q in odds.items())


def test_drift_of_two_spans_is_near_the_exact_one(spark, table):
    moved = table.withColumn("a", F.when(F.col("ts") >= "2024-01-11", F.col("a") * 1.4).otherwise(F.col("a")))
    found = {r.feature: r.psi for r in sketches.psi(sketches.daily_sketches(moved, [], "ts", ["a", "b"]), ("2024-01-01", "2024-01-10"), ("2024-01-11", "2024-01-20")).collect()}
    sides = [moved.filter(f"ts {op} '2024-01-11'").select("a", "b").unpivot([], ["a", "b"], "feature", "value").filter("value is not null") for op in ("<", ">=")]
    want = {r.feature: r.psi for r in scoring.psi(*sides).collect()}
    assert abs(found["a"] - want["a"]) < 0.1 * want["a"] and want["a"] > 0.1
    assert found["b"] < 0.01 and want["b"] < 0.01


def test_few_distinct_values_and_constants(spark):
    rows = [(D0 + dt.timedelta(days=i % 2), float(i // 2 % 3), 1.0) for i in range(600)]
    daily = sketches.daily_sketches(spark.createDataFrame(rows, "ts timestamp, a double, b double"), [], "ts", ["a", "b"])
    found = {r.feature: r.psi for r in sketches.psi(daily, ("2024-01-01", "2024-01-01"), ("2024-01-02", "2024-01-02")).collect()}
    assert found["a"] == pytest.approx(0, abs=1e-9) and "b" not in found  # one edge makes no bin


def test_crps_equals_a_double_loop(spark):
    rng = random.Random(2)
    rows = [("s", r, t, float(max(0, rng.gauss(3 + r, 4)))) for r in range(2) for t in range(40)]
    df = spark.createDataFrame(rows, "sku string, region int, t int, demand double")
    found = {(r.region, r.t): r.crps for r in forecast.crps(df, 29, 8, season=5).collect()}
    value = {(r, t): d for _, r, t, d in rows}
    for region in range(2):
        errors = [value[region, t] - value[region, t - 5] for t in range(5, 30)]
        for t in range(30, 38):
            naive = value[region, t - 5 if t - 5 <= 29 else t - 10]
            x = [max(0.0, naive + e) for e in errors]
            want = sum(abs(a - value[region, t]) for a in x) / len(x) - sum(abs(a - b) for a in x for b in x) / (2 * len(x) ** 2)
            assert found.pop((region, t)) == pytest.approx(want)
    assert not found


def test_a_horizon_longer_than_a_season(spark):
    df = spark.createDataFrame([("s", 1, t, float(t % 4)) for t in range(40)], "sku string, region int, t int, demand double")
    rows = forecast.quantile_forecast(df, 19, 11, season=4).orderBy("t").collect()
    assert [r.t for r in rows] == list(range(20, 31)) and all(r.p50 == r.t % 4 for r in rows)
    assert [(r.horizon, r.n) for r in forecast.by_horizon(df, 19, [3]).collect()] == [(3, 0)]  # no error a season of 52 earlier
