"""Rows worked out by hand from the stated formulas."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bronze, forecast, geo, gold, loss, network, scoring, silver


def test_country_weights(spark):
    """0.30 instability, 0.25 trade, 0.20 conflict, 0.15 port, 0.10 volatility."""
    conflict = spark.createDataFrame([("a", "20000105", 0.0, 1, 0.0)], "country_code string, event_date_str string, goldstein_scale double, num_articles int, avg_tone double")
    ports = spark.createDataFrame([("a", dt.date(2000, 1, 5), 42.0)], "country_code string, event_date date, wait_time_hours double")
    gov = spark.createDataFrame([("a", 2000, 1.5)], "country_code string, year int, political_stability_wgi double")
    trade = spark.createDataFrame([("a", "2000-01", 0.8, 2, 0.1)], "reporter_country_code string, period string, trade_deficit_ratio double, tariff_dispute_flag int, import_concentration_hhi double")
    prices = spark.createDataFrame([("c", dt.date(2000, 1, 4), 10.0), ("c", dt.date(2000, 1, 5), 14.0)], "commodity_code string, price_date date, close_price double")
    row = geo.country_risk(conflict, ports, gov, trade, prices).first()
    volatility = (8**0.5) / 12
    assert row.geo_score == pytest.approx(0.30 * 0.2 + 0.25 * 0.6 + 0.20 * 0.5 + 0.15 * 0.25 + 0.10 * volatility)
    alone = geo.country_risk(conflict, ports.limit(0), gov.limit(0), trade.limit(0), prices.limit(0)).first()
    assert alone.geo_score == pytest.approx(0.30 * 0.5 + 0.20 * 0.5) and alone.geo_risk_tier == "MEDIUM"


SHIP = "purchase_order_id string, supplier_id string, event_date date, expected_delivery_date timestamp, delay_days double, canonical_status string, dq_score double, cargo_value_usd double, transport_mode string, origin_port string, destination_port string"


def _ships(spark):
    day = lambda i: dt.date(2000, 3, 1) + dt.timedelta(i)
    kinds = [("DELIVERED", -1.0), ("DELAYED", 6.0), ("EXCEPTION", 2.0), ("CUSTOMS_HOLD", -2.0), ("DELIVERED", 0.0), ("DELIVERED", None)]
    rows = [(f"p{i}", "s", day(i), dt.datetime(2000, 12, 31), d, k, 0.9, None if i == 0 else 100.0, "OCEAN", "x", "y") for i, (k, d) in enumerate(kinds[:5])]
    return spark.createDataFrame([*rows, ("p9", "s", day(9), None, None, "DELIVERED", 0.9, 5.0, "TRUCK", "x", "y"), ("p8", None, day(8), None, 1.0, "DELIVERED", 0.9, 5.0, "TRUCK", "x", "y")], SHIP)


def test_only_exceptions_are_disruptions(spark):
    rows = {r.purchase_order_id: r for r in silver.last_disruption(silver.rolling(silver.events(_ships(spark).filter("delay_days is not null"))), "2000-03-31").collect()}
    assert "p8" not in rows and [rows[f"p{i}"].disruptions_90 for i in range(5)] == [0, 0, 1, 1, 1]
    assert rows["p4"].disruption_rate_90 == pytest.approx(1 / 5) and rows["p4"].days_since_disruption == 28 and rows["p1"].last_disruption is None


def test_newest_values_agree_with_the_windows(spark):
    late = [(7 * i * i) % 5 - 2 for i in range(130)]
    rows = [(f"p{i:03}", s, dt.date(2000, 1, 1) + dt.timedelta(i // 2), None, float(d), "EXCEPTION" if i % 11 == 3 else "DELIVERED", 0.9, 1.0, "TRUCK", "x", str(i % 3)) for s, part in (("a", late), ("b", late[:3]), ("c", [0] * 4)) for i, d in enumerate(part)]
    events = silver.events(spark.createDataFrame(rows, SHIP))
    want = silver.latest(silver.streak(silver.last_disruption(silver.rolling(events), "2001-01-01")), "supplier_id", "event_date", "purchase_order_id")
    names = ["on_time_rate_7", "on_time_rate_30", "on_time_rate_90", "delay_mean_30", "delay_mean_90", "delay_std_90", "disruption_rate_90", "ewm_proxy", "drift_proxy", "trend_proxy", "lead_time_variance", "days_since_disruption", "on_time_streak"]
    found = {r.supplier_id: r for r in silver.newest_values(events, "2001-01-01").collect()}
    for r in want.collect():
        for n in names:
            assert found[r.supplier_id][n] == (pytest.approx(r[n]) if r[n] is not None else None), (r.supplier_id, n)


def test_supplier_defaults(spark):
    suppliers = spark.createDataFrame([("s", "a", 50.0, 0.9, None), ("t", None, -5.0, 0.9, 40.0), ("u", "a", 1.0, 0.5, 1.0)], "supplier_id string, country_code string, annual_spend_usd double, dq_score double, financial_score_ext double")
    country = spark.createDataFrame([("a", dt.date(2000, 1, 1), 0.4, "MEDIUM", 0.2, 0.1, 0.0, 0.3)], "country_code string, event_date date, geo_score double, geo_risk_tier string, instability double, trade_score double, port_score double, volatility double")
    central = spark.createDataFrame([("s", 0.5)], "supplier_id string, network_pagerank double")
    rows = {r.supplier_id: r for r in silver.supplier_features(suppliers, _ships(spark).filter("delay_days is not null and supplier_id is not null"), country, central, "2000-03-31").collect()}
    assert set(rows) == {"s", "t"}
    t = rows["t"]
    assert (t.on_time_rate_7, t.on_time_rate_90, t.ewm_proxy, t.on_time_streak, t.days_since_disruption) == (1.0, 1.0, 1.0, 30, 365)
    assert (t.geo_score, t.instability, t.network_pagerank, t.order_volume_90, t.transit_route_risk, t.financial_risk) == (0.3, 0.3, 0.01, 0, 0.0, pytest.approx(0.6))
    s = rows["s"]
    assert (s.on_time_streak, s.days_since_disruption, s.order_volume_90, s.financial_risk, s.network_pagerank) == (2, 28, 5, 0.3, 0.5)
    assert s.political_stability == pytest.approx(1.5) and s.transit_route_risk == 0.25 and s.spend_share_pct == pytest.approx(5000 / 51)


def test_shipment_features(spark):
    """Calendar of the expected day; null cargo and delay are 0; five features of the supplier, or their defaults."""
    features = spark.createDataFrame([("s", 0.7, 0.2, 0.6, 0.1, 0.05)], "supplier_id string, disruption_rate_90 double, on_time_rate_90 double, geo_score double, financial_risk double, network_pagerank double")
    rows = {r.purchase_order_id: r for r in silver.shipment_features(_ships(spark), features).collect()}
    a, b, c = rows["p0"], rows["p9"], rows["p8"]
    assert (a.month, a.quarter, a.is_q4, a.is_weekend, a.day_of_week, a.log_cargo, a.label) == (12, 4, 1, 1, 1, 0.0, 0)
    assert (b.delay_days, b.label, b.month_sin, b.month_cos, b.is_q4) == (0.0, 0, 0.0, 1.0, 0)
    assert [rows[f"p{i}"].label for i in range(5)] == [0, 1, 1, 1, 0]
    assert (a.sup_disruption_rate_90, a.sup_geo_score, a.sup_network_pagerank) == (0.7, 0.6, 0.05)
    assert (c.sup_disruption_rate_90, c.sup_on_time_rate_90, c.sup_geo_score, c.sup_financial_risk, c.sup_network_pagerank) == (0.1, 0.9, 0.3, 0.3, 0.01)


def test_exact_ewm_is_a_fold_over_all_events(spark):
    flags = [(i * i) % 3 == 0 for i in range(140)]
    rows = [("s", dt.date(2000, 1, 1) + dt.timedelta(i), f"p{i:03}", int(f)) for i, f in enumerate(flags)]
    want = float(flags[0])
    for f in flags[1:]:
        want = 0.8 * want + 0.2 * f
    assert silver.exact_ewm(spark.createDataFrame(rows, "supplier_id string, event_date date, purchase_order_id string, on_time int")).first().ewm == pytest.approx(want)


def test_losses(spark):
    """Lost revenue for the draw beyond the stock, substitution for the mean lead time; contagion comes first."""
    scenarios = spark.createDataFrame([(1, "a", 1, 20.0), (1, "b", 0, 9.0), (2, "b", 0, 9.0)], "scenario_id int, supplier_id string, disrupted int, lead_time_draw double")
    edges = spark.createDataFrame([("a", "b", 0.6), ("a", "c", 0.5), ("a", "d", 0.9)], "src string, dst string, c double")
    second = loss.spread_disruption(scenarios, edges)
    assert {(r.scenario_id, r.supplier_id): (r.disrupted, r.second) for r in second.collect()} == {(1, "a"): (1, 1), (1, "b"): (0, 1), (1, "d"): (0, 1), (2, "b"): (0, 0)}
    suppliers = spark.createDataFrame([("a", 10.0, 1.5), ("b", 8.0, 1.25), ("c", 1.0, 9.0), ("d", 4.0, 2.0)], "supplier_id string, avg_lead_time_days double, substitution_cost_factor double")
    stock = spark.createDataFrame([("a", 5.0, 100.0), ("a", None, 10.0), ("b", 30.0, 40.0), ("d", 1.0, 1.0)], "supplier_id string, days_of_supply double, avg_daily_revenue double")
    found = {r.scenario_id: r.loss for r in loss.scenario_losses(second, stock, suppliers).collect()}
    a = 15 * 100 + 100 * 10 * 0.5 + 20 * 10 + 10 * 10 * 0.5
    b = 0 + 40 * 8 * 0.25
    d = 3 * 1 + 1 * 4 * 1.0  # no draw of its own: the mean
    assert found == {1: pytest.approx(a + b + d), 2: 0.0}
    assert loss.any_disruption(second).first().p_any == 0.5


def test_explanations_and_percentiles(spark):
    z = spark.createDataFrame([(-3.0,), (-1.0,), (0.0,), (1.0,), (1.96,)], "z double").select(scoring.normal_percentile("z")).collect()
    assert [r[0] for r in z] == [0.1, 15.9, 50.0, 84.1, 97.5]
    long = spark.createDataFrame([(i, f, float(v)) for i in range(4) for f, v in (("x", i), ("y", -2 * i), ("k", 1))], "id int, feature string, value double")
    row = scoring.explanations(long, spark.createDataFrame([(3, 0.9, 1)], "id int, score double, flag int"), "id", 2).first()
    assert row.top_features == ["x", "y"] and row.z_map == {"x": 1.342, "y": -1.342, "k": 0.0} and row.percentile_map == {"x": 91.0, "y": 9.0, "k": 50.0}


def test_detector_report_and_alerts(spark):
    scored = spark.createDataFrame([(1, 0.9, 1), (2, 0.7, 0), (3, 0.65, 1), (4, 0.1, 0)], "id int, ensemble double, label int").withColumn("is_anomaly", (F.col("ensemble") >= 0.6).cast("int"))
    row = scoring.detector_report(scored, "label").first()
    assert tuple(row) == (0.75, 0.75, 0.5, 0.6, 4)
    assert tuple(scoring.anomaly_kpis(scored).first()) == (3, 0.75, 0.9)
    assert [(r.id, r.badge) for r in scoring.top_alerts(scored, "id", k=2).collect()] == [(1, "CRITICAL"), (2, "HIGH")]


def test_texts_and_filters(spark):
    risk = spark.createDataFrame([("a", 0.71234, "CRITICAL"), ("b", 0.55, "HIGH"), ("c", 0.3, "MEDIUM")], "supplier_id string, composite double, risk_tier string")
    assert [r.supplier_id for r in gold.risk_filter(risk, [], 0.3, 2).collect()] == ["a", "b"] and [r.supplier_id for r in gold.risk_filter(risk, ["MEDIUM", "HIGH"], 0.3, 5).collect()] == ["b", "c"]
    likely = spark.createDataFrame([("a", 0.71234, "CRITICAL"), ("b", 0.9, "HIGH"), ("c", 0.7, "HIGH"), ("d", None, "LOW")], "supplier_id string, disruption_probability double, risk_tier string")
    rows = gold.alerts(likely).collect()
    assert [(r.supplier_id, r.urgency, r.status) for r in rows] == [("a", "CRITICAL", "SENT"), ("b", "HIGH", "SENT")] and rows[0].risk_summary == "Supplier a is CRITICAL with a disruption probability of 0.7123"
    parts = spark.createDataFrame([("a", "x", 0.25), ("a", "y", -0.5), ("a", "z", 0.1)], "supplier_id string, feature string, value double")
    assert gold.narrative(parts, k=2).first().narrative == "  y: -0.5000 (↓ risk)\n  x: +0.2500 (↑ risk)"


def test_spend_within_reach(spark):
    reached = spark.createDataFrame([("a", "a", 0), ("a", "b", 1), ("a", "c", 2)], "seed string, id string, hop int")
    spend = spark.createDataFrame([("a", 10.0), ("b", 20.0), ("c", -5.0), ("d", 30.0)], "supplier_id string, annual_spend_usd double")
    assert tuple(network.spend_coverage(reached, spend).first()) == ("a", 1, 1, 0, 50.0)


def test_scaling_goes_back(spark):
    rows = spark.createDataFrame([("a", 1, t, float(t * t)) for t in range(5)] + [("b", 1, t, 7.0) for t in range(3)], "sku string, region int, t int, demand double")
    assert all(r.restored == pytest.approx(r.demand) for r in forecast.unscale(forecast.standardise(rows)).collect())


def test_reports(spark):
    country = spark.createDataFrame([("CRITICAL",), ("LOW",), ("LOW",), ("HIGH",)], "geo_risk_tier string")
    assert tuple(gold.geo_report(country).first()) == (4, 1, 0.25)
    assert tuple(gold.label_report(spark.createDataFrame([(1,), (0,)], "label int")).first()) == (2, 0.5)
    assert bronze.shipment_report(spark.createDataFrame([(1, 0.5), (0, 1.0)], "is_late int, dq_score double")).first().late_rate == 0.5


def test_actions_by_their_triggers(spark):
    risk = spark.createDataFrame([(1, 0.71, "LOW"), (2, 0.7, "CRITICAL"), (3, None, "HIGH")], "supplier_id long, disruption_probability double, risk_tier string").withColumn("composite", F.lit(0.5))
    stock = spark.createDataFrame([(10, 1, 6.9), (11, 2, 7.0), (12, 3, None)], "sku_id long, supplier_id long, days_of_supply double")
    metrics = lambda v: spark.createDataFrame([(v,)], "var_95 double")
    found = sorted((r.action, r.supplier_id, r.measure) for r in gold.actions(risk, stock, metrics(2e6)).collect())
    assert found == [("ALERT", 1, 0.71), ("BACKUP", 2, 0.5), ("ESCALATE", None, 2e6), ("PURCHASE_ORDER", 1, 6.9)]
    assert "ESCALATE" not in {r.action for r in gold.actions(risk, stock, metrics(1e6)).collect()}
