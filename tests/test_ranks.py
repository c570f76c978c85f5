"""Two-step totals and quantiles against plain ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranks, scoring


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    values = [("a", float(v)) for v in rng.lognormal(0, 3, 900)] + [("b", float(v)) for v in rng.integers(0, 4, 300)] + [("c", 7.0), ("a", None)]
    return spark.createDataFrame(values, "g string, v double").repartition(5)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(rows, descending):
    counts = rows.filter("v is not null").groupBy("g", "v").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    found = ranks.running_totals(counts, ["g"], "v", ["n", "s"], descending, parts=8).collect()
    assert len(found) == counts.count()
    for g in "abc":
        own = sorted((r for r in found if r.g == g), key=lambda r: r.v, reverse=descending)
        assert [r.n_upto for r in own] == np.cumsum([r.n for r in own]).tolist() and {r.n_all for r in own} == {sum(r.n for r in own)}
        assert np.allclose([r.s_upto for r in own], np.cumsum([r.s for r in own]))


def test_quantiles(rows):
    odds = {"low": 0.0, "q": 0.237, "mid": 0.5, "high": 1.0}
    values = {}
    for r in rows.filter("v is not null").collect():
        values.setdefault(r.g, []).append(r.v)
    for r in ranks.quantiles(rows, ["g"], "v", odds).collect():
        assert [r[n] for n in odds] == pytest.approx([np.quantile(values[r.g], q) for q in odds.values()])
    everything = sum(values.values(), [])
    one = ranks.quantiles(rows, [], "v", odds).first()
    assert [one[n] for n in odds] == pytest.approx([np.quantile(everything, q) for q in odds.values()])
    assert ranks.quantiles(rows.filter("g = 'none'"), ["g"], "v", odds).count() == 0


def test_look_up_hot_and_rare_keys(spark):
    rows = spark.createDataFrame([(i, "a", float(i % 7 if i % 3 else 0)) for i in range(300)], "i int, g string, v double")
    table = rows.groupBy("g", "v").agg(F.count("*").alias("n")).withColumns({"n_all": F.lit(300), "x": F.col("v") * 2})
    for share in (1, 5, 1000):
        found = ranks.look_up(rows, table, ["g", "v"], share=share).collect()
        assert sorted(r.i for r in found) == list(range(300)) and all(r.x == 2 * r.v for r in found)


@pytest.mark.parametrize("q", [0.0, 0.37, 0.95, 1.0])
def test_a_quantile_of_all_rows_from_bins(spark, q):
    rng = random.Random(5)
    values = [rng.choice([0.5, 7.25, rng.random() * 30, None]) for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    want = ranks.quantiles(rows, [], "v", {"x": q}).first().x
    assert ranks.whole_quantile(rows, "v", q, "x").first().x == want
    assert ranks.whole_quantile(rows.filter("v is null"), "v", q, "x").first().x is None
    assert ranks.whole_quantile(rows.filter("v = 7.25"), "v", q, "x").first().x == 7.25


def test_tails_of_whole_rows_equal_those_of_the_long_form(spark):
    """Values that are frequent, rare, null and repeated keys; rows are not cut into a row per feature, so the plan has no unpivot by key."""
    rng = random.Random(6)
    rows = [(f"k{rng.randrange(4800)}", rng.choice([0.0, None, float(rng.randrange(3000))]), float(rng.randrange(3)), rng.random()) for _ in range(5000)]
    df = spark.createDataFrame(rows, "k string, a double, b double, c double")
    found = {r.k: r for r in scoring.tail_scores(df, "k", "a", "b", "c").collect()}
    want = {r.k: r for r in scoring.ecod(scoring.long_form(df, "k", "a", "b", "c"), "k").collect()}
    assert found.keys() == want.keys()
    for k, r in want.items():
        assert abs(found[k].raw - r.raw) < 1e-9 and abs(found[k].score - r.score) < 1e-9 and found[k].flag == r.flag
    assert "Expand" not in scoring.tail_table(df, "k", "a", "b", "c")._jdf.queryExecution().executedPlan().toString()


def test_a_detector_report_reads_its_rows_once(spark):
    rng = random.Random(8)
    rows = spark.createDataFrame([(rng.randrange(2), rng.random()) for _ in range(300)], "label int, ensemble double")
    found = scoring.detector_report(rows, "label")
    assert "ExistingRDD" not in found._jdf.queryExecution().toString()
    one, all_rows = found.first(), rows.collect()
    pairs = [(a.ensemble > b.ensemble) for a in all_rows if a.label for b in all_rows if not b.label]
    assert abs(one.roc_auc - sum(pairs) / len(pairs)) < 1e-9 and one.n_samples == 300
