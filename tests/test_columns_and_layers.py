import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import bronze, geo, gold, loss, network, scoring, silver
from tidemark.sources import tables


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column("x")).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("$1,234.50", 1234.5), (" 7 ", 7.0), ("n/a", None), ("", None), ("-$5", -5.0), (None, None)])
def test_currency(spark, raw, want):
    assert one(spark, C.currency, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("12", 12), ("12.5", 12), ("x", None), (None, None)])
def test_whole(spark, raw, want):
    assert one(spark, C.whole, raw) == want


def test_flags_status_and_modes(spark):
    rows = spark.createDataFrame([("y",), ("Yes",), ("1",), ("true",), ("N",), ("",), (None,)], "x string").select(C.truthy("x")).collect()
    assert [r[0] for r in rows] == [1, 1, 1, 1, 0, 0, 0]
    pairs = {"dl": "DELIVERED", "Transit": "IN_TRANSIT", "at_risk": "AT_RISK", None: "UNKNOWN", "??": "UNKNOWN", "De": "EXCEPTION"}
    rows = spark.createDataFrame([(k,) for k in pairs], "x string").select(C.canonical_status("x")).collect()
    assert [r[0] for r in rows] == list(pairs.values())
    assert [one(spark, C.transport_mode, x) for x in ("MSC", "DHL", "LOCAL", None)] == ["OCEAN", "AIR_PARCEL", "TRUCK", "TRUCK"]


def test_clamp_and_tiers(spark):
    values = [None, -3.0, 7.0, 0.4]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(C.clamp01("x")).collect()] == [1.0, 0.0, 1.0, 0.4]
    df = spark.createDataFrame([(v,) for v in (0.0, 0.2, 0.25, 0.4, 0.5, 0.7, 0.75, None)], "x double").select(C.geo_tier("x").alias("a"), C.gold_tier("x").alias("b"), C.model_tier("x").alias("c"))
    rows = df.collect()
    assert [r.a for r in rows] == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "LOW"]
    assert [r.b for r in rows] == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "CRITICAL", "LOW"]
    assert [r.c for r in rows] == [None, "LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", None]


def test_delay(spark):
    d = lambda x: x and dt.datetime.fromisoformat(x)
    rows = [(d("2024-01-01"), d("2024-01-04")), (d("2024-01-01"), None), (d("2024-03-01"), None), (None, d("2024-01-01")), (None, None)]
    df = spark.createDataFrame(rows, "e timestamp, a timestamp").select(bronze.delay_days("e", "a", "2024-01-11"))
    assert [r[0] for r in df.collect()] == [3.0, 10.0, 0.0, 0.0, 0.0]


def test_supplier_score(spark):
    base = ("1", " name ", "xx", "r", "c", "$5", "spot", "30", "4", "Y", "1", "2001-10-01 00:00:00", "50", "m")
    raw = spark.createDataFrame([base, (*base[:5], None, *base[6:]), (None, *base[1:]), (*base[:8], "0", *base[9:])], tables.SUPPLIER_MASTER)
    found = bronze.suppliers(tables.lower_columns(raw))
    assert [r.dq_score and round(r.dq_score, 6) for r in found.collect()] == [1.0, None, 0.6, 0.9]
    assert bronze.suppliers(tables.lower_columns(raw), null_flag_as=0).collect()[1].dq_score == 1.0
    assert found.first().supplier_name == "Name"


def _events(spark, late):
    rows = [("s", dt.date(2024, 1, 1 + i), f"p{i}", 1 - x, float(5 * x), 0) for i, x in enumerate(late)]
    return spark.createDataFrame(rows, "supplier_id string, event_date date, purchase_order_id string, on_time int, delay_days double, disrupted int")


def test_streak(spark):
    rows = silver.streak(_events(spark, [0, 0, 1, 0, 0, 1, 0]).repartition(3)).orderBy("event_date").collect()
    assert [r.on_time_streak for r in rows] == [1, 2, 0, 1, 2, 0, 1]


def test_ewm_of_a_constant(spark):
    assert silver.exact_ewm(_events(spark, [0] * 7)).first().ewm == pytest.approx(1.0)


def test_sparse_routes(spark):
    rows = [("a", "b", 1, 1.0, 1.0)] * 9 + [("a", "c", 1, 1.0, 1.0)] * 10
    df = spark.createDataFrame(rows, "origin_port string, destination_port string, label int, delay_days double, cargo_value_usd double")
    assert {r.destination_port: r.route_risk for r in silver.route_stats(df).collect()} == {"b": 0.25, "c": 1.0}


def test_average_rank(spark):
    df = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, 0.5), (4, 0.1)], "id long, p double")
    assert [r.place for r in scoring.average_rank(df).orderBy("id").collect()] == [1, 2, 2, 4]


def test_ecod_tails(spark):
    long = spark.createDataFrame([(i, "f", float(i)) for i in (1, 2, 3, 4)], "id long, feature string, value double")
    found = {r.id: r.raw for r in scoring.ecod(long, "id").collect()}
    assert found == pytest.approx({1: 1.386294, 2: 0.693147, 3: 1.386294, 4: 20.723266}, rel=1e-5)


@pytest.mark.parametrize(("rows", "want"), [([(1, 0.9), (0, 0.1)], 1.0), ([(1, 0.5), (0, 0.5)], 0.5), ([(1, 0.5), (1, 0.2)], None)])
def test_auc(spark, rows, want):
    df = spark.createDataFrame(rows, "y int, p double").withColumn("m", F.lit(1))
    assert scoring.auc(df, ["m"]).first().auc == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 5)), min_size=2, max_size=30).filter(lambda x: len({y for y, _ in x}) == 2))
def test_auc_against_all_pairs(spark, rows):
    df = spark.createDataFrame([(y, p / 5) for y, p in rows], "y int, p double").withColumn("m", F.lit(1))
    pairs = [(a > b) + 0.5 * (a == b) for y, a in rows for z, b in rows if y and not z]
    assert scoring.auc(df, ["m"]).first().auc == pytest.approx(sum(pairs) / len(pairs))
    flipped = df.withColumn("p", 1 - F.col("p"))
    assert scoring.auc(flipped, ["m"]).first().auc == pytest.approx(1 - sum(pairs) / len(pairs))


def test_psi_and_kl(spark):
    ref = spark.createDataFrame([("f", float(i)) for i in range(100)] + [("c", 1.0)] * 100, "feature string, value double")
    assert {r.feature: r.psi for r in scoring.psi(ref, ref).collect()} == pytest.approx({"f": 0, "c": 0}, abs=1e-9)
    above = ref.withColumn("value", F.when(F.col("feature") == "f", F.col("value") + 1000).otherwise(F.col("value")))
    assert {r.feature: r.psi for r in scoring.psi(ref, above).collect()}["f"] > 1
    scores = spark.createDataFrame([(i / 50,) for i in range(51)], "score double")
    assert scoring.kl(scores, scores).first().kl == pytest.approx(0, abs=1e-9)


def test_tail_and_return(spark):
    metrics = loss.tail_metrics(spark.createDataFrame([(i, float(i)) for i in range(1, 101)], "scenario_id int, loss double"))
    row = metrics.first()
    assert (row.var_95, row.cvar_95) == (pytest.approx(95.05), 98.0) and row.cvar_99 >= row.var_99
    options = spark.createDataFrame([("o", 0.35, 20.0)], "name string, reduction double, cost double")
    r = loss.mitigation(options, spark.createDataFrame([(100.0,)], "cvar_95 double")).first()
    assert (r.avoided, r.net, r.roi_pct, r.payback_months) == (pytest.approx(35), pytest.approx(15), pytest.approx(75), pytest.approx(6.857, rel=1e-3))


def test_question_routes(spark):
    asked = {"Critical exposure": "risk", "variable": "var", "hello": "default", "an unusual day": "anomaly"}
    rows = spark.createDataFrame([(q,) for q in asked], "q string").select(gold.route_question("q")).collect()
    assert [r[0] for r in rows] == list(asked.values())


def test_governance_as_of(spark):
    days = spark.createDataFrame([("a", dt.date(1996, 5, 1)), ("a", dt.date(1999, 1, 1)), ("a", dt.date(1990, 1, 1)), ("b", dt.date(1999, 1, 1))], "country_code string, event_date date")
    gov = spark.createDataFrame([("a", 1995, 1.0), ("a", 1997, 2.0)], "country_code string, year int, political_stability_wgi double")
    found = {(r.country_code, r.event_date.year): r.wgi for r in geo.governance_as_of(days, gov).collect()}
    assert found == {("a", 1996): 1.0, ("a", 1999): 2.0, ("a", 1990): None, ("b", 1999): None}


def test_pagerank_sums_to_one(spark):
    nodes = spark.range(5).select("id")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 2.0), (2, 3, 1.0)], "src long, dst long, flow_volume double")
    ranks = {r.id: r["rank"] for r in network.pagerank(nodes, edges, rounds=3).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and min(ranks, key=ranks.get) == 4


def test_rewrite_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, day string")
    for _ in range(2):
        tables.write_partitions(df, f"{tmp_path}/t", "day")
    tables.write_partitions(df.filter("x = 1"), f"{tmp_path}/t", "day")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    assert "_bronze_layer" in tables.with_audit(df, "erp", "bronze", "2024-01-01").columns
