"""Rounding and printing of doubles as DuckDB does."""

import random

import duckdb

from tidemark.functions import columns as C
from tidemark.operators import gold, scoring


def test_ties_are_rounded_and_printed_as_in_sql(spark):
    rng = random.Random(5)
    values = [0.98765, 0.00005, 1.000005, 2.675, 0.125, 0.375, -0.125, -2.675, 1234567.5, 1234568.5, 0.0, -0.001, -0.00001, 12.999, 1e12 + 0.5]
    values += [rng.randrange(10**9) / 10 ** rng.randrange(1, 7) for _ in range(3000)] + [-rng.random() * 1000 for _ in range(500)]
    values += [round(rng.random(), 6) for _ in range(2000)] + [round(rng.random(), 5) for _ in range(1000)]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    from pyspark.sql import functions as F

    found = frame.select("x", C.rounded("x", 4).alias("r"), *(F.format_string(f"%.{n}f", C.printed("x", n)).alias(f"p{n}") for n in (0, 2, 4)), F.format_string("%+.4f", C.printed(C.rounded("x", 4, signed=True), 4)).alias("s")).collect()
    con = duckdb.connect()
    con.execute("create table t (x double)")
    con.executemany("insert into t values (?)", [(v,) for v in values])
    want = {r[0]: r[1:] for r in con.execute("select x, round(x, 4), printf('%.0f', x), printf('%.2f', x), printf('%.4f', x), printf('%+.4f', round(x, 4)) from t").fetchall()}
    for r in found:
        assert (r.r, r.p0, r.p2, r.p4, r.s) == want[r.x], r


def test_texts_keep_the_sign_of_a_rounded_zero(spark):
    rows = [(i, "a", v) for i, v in enumerate([4.0, 6.0, 4.9999, 5.0003])]
    z = scoring.z_scores(spark.createDataFrame(rows, "k int, feature string, value double"), signed=True)
    found = {r.k: r.narrative for r in gold.narrative(z.withColumn("value", C.col("z")), "k").collect()}
    con = duckdb.connect()
    con.execute("create table t as select * from (values (0, 4.0::double), (1, 6.0), (2, 4.9999), (3, 5.0003)) v(k, x)")
    want = dict(con.execute("select k, printf('%+.4f', round((x - m) / (d + 1e-9::double), 3)) from t cross join (select avg(x) as m, stddev_pop(x) as d from t)").fetchall())
    assert "-0.0000" in want.values()
    for k, text in want.items():
        assert f": {text} " in found[k]


def test_scores_and_money_in_texts(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.randrange(10**5) / 10**5, rng.randrange(10**7) / 10**4, rng.randrange(10**6) + 0.5) for i in range(400)]
    con = duckdb.connect()
    con.execute("create table t (k int, score double, pct double, loss double)")
    con.executemany("insert into t values (?, ?, ?, ?)", rows)
    records = spark.createDataFrame(rows, "k int, score double, pct double, loss double")
    from pyspark.sql import functions as F

    texts = gold.anomaly_text(records.select("k", "score", F.lit("f").alias("feature"), "pct", F.col("pct").alias("value"), F.col("score").alias("mean"), F.lit(0.0).alias("deviation"), F.lit(1.5).alias("z")), "k", 0.6)
    want = dict(con.execute("select k, printf('Anomaly of %d: score %.4f (threshold 0.60); f is %.2f, expected %.2f to %.2f, z +1.500', k, score, pct, round(score, 4), round(score, 4)) from t").fetchall())
    assert {r.k: r.text for r in texts.collect()} == want
    for _, _, pct, loss in rows[:12]:
        totals = spark.createDataFrame([(1, pct, 2, 3, 4, pct)], "n_critical long, pct_spend_at_risk double, n_high long, skus_under_7 long, skus_under_14 long, revenue_at_risk double")
        metrics = spark.createDataFrame([(loss,) * 3], "mean_loss double, var_95 double, cvar_95 double")
        said = gold.briefing_text(totals, metrics).first().text
        p, n = con.execute("select printf('%.2f', ?::double), printf('%.0f', ?::double)", [pct, loss]).fetchall()[0]
        assert f"({p}% of" in said and f"loss {n}, VaR(95%) {n}, CVaR(95%) {n}." in said and said.endswith(f"at risk {p}.")
