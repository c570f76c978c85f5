"""Whole and exact results where a cut or an estimate stood before."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import bronze, loss, models, network, scoring, sketches
from tidemark.plans import learning, registry
from tidemark.sources.adapters import Feeds
from tidemark.sources.stored import shared_dir, store
from tidemark.streaming import streams

D0 = dt.datetime(2024, 1, 1)
SMALL = "/root/testdata/sf0.001"


def test_windows_of_panes_over_several_batches(spark):
    """Late days are left out, open windows as well; a batch that comes again changes nothing."""
    rng = random.Random(1)
    path = f"{shared_dir(spark)}/panes-test"
    batches = [[(s, D0 + dt.timedelta(days=rng.randrange(20 * k, 20 * k + 20)), rng.randrange(2)) for s in range(3) for _ in range(40)] for k in range(3)]
    batches[2].append((1, D0, 1))  # its day is closed by then
    write = streams.pane_writer(path)
    for number in (0, 1, 1, 2):
        write(spark.createDataFrame(batches[number], "supplier_id long, event_timestamp timestamp, on_time int"), number)
    rows = [r for b in batches for r in b][:-1]
    mark = max(r[1] for r in rows) - dt.timedelta(days=1)
    want = {}
    for s, at, ok in rows:
        for back in range(7):
            start = at - dt.timedelta(days=back)
            if start + dt.timedelta(days=7) <= mark:
                n, good = want.get((s, start), (0, 0))
                want[s, start] = (n + 1, good + ok)
    found = {(r.supplier_id, r.start): (r.n, r.rate) for r in streams.pane_windows(spark, path, 7).collect()}
    assert found == {k: (n, good / n) for k, (n, good) in want.items()}


def test_reach_counts_are_exact(spark):
    rng = random.Random(4)
    edges = sorted({(i, rng.randrange(3000)) for i in range(3000) for _ in range(8)})
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = {r.id: r for r in network.reach_counts(spark.createDataFrame(edges, "src long, dst long"), spark.range(3000), 3).collect()}
    assert len(found) == 3000
    for seed, r in found.items():
        seen = {seed}
        for hop in (1, 2, 3):
            seen |= {b for a in seen for b in out.get(a, ())}
            assert r[f"n_hop{hop}"] == len(seen) - 1


def test_profiles_from_counts_are_exact(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), D0 + dt.timedelta(days=rng.randrange(10)), float(rng.randrange(4000))) for _ in range(20_000)]
    table = sketches.daily_counts(spark.createDataFrame(rows, "k string, ts timestamp, v double"), ["k"], "ts", ["v"])
    for r in sketches.exact_profile(table, ["k"], "2024-01-02", "2024-01-08", {"median": 0.5, "p90": 0.9}).collect():
        own = sorted(v for k, at, v in rows if k == r.k and 1 <= (at - D0).days <= 7)
        assert (r.n, r.least, r.greatest, r.median, r.p90) == (len(own), own[0], own[-1], own[-(-len(own) // 2) - 1], own[-(-len(own) * 9 // 10) - 1])


def test_equal_sums_of_contagion_go_by_source(spark):
    rng = random.Random(7)
    rows = []
    for src in range(40):
        shares = [rng.random() for _ in range(30)]
        rows += [(src, 100 + i, 1.98 * x / sum(shares)) for i, x in enumerate(shares)]
    found = network.contagion_order(spark.createDataFrame(rows, "src long, dst long, c double").repartition(7), 100).collect()
    assert [r.src for r in found] == [0, 1, 2, 3, 4]


def test_open_sessions_are_counted(spark):
    total = registry.queries()["st_session"](spark, SMALL).agg(F.sum("n")).first()[0]
    assert total == spark.read.parquet(f"{SMALL}/events.parquet").count()


def test_losses_take_all_flows_and_all_lines(spark):
    f = Feeds(spark, SMALL)
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    sold = f.whole_inventory().agg(F.sum("daily_demand")).first()[0] * 2500
    assert abs(sold - lines.agg(F.sum("l_quantity")).first()[0]) < 1e-3
    shared = lines.select("l_orderkey", F.col("l_suppkey").alias("a")).join(lines.select("l_orderkey", F.col("l_suppkey").alias("b")), "l_orderkey").filter("a <> b").select("a", "b").distinct()
    assert f.order_edges().count() == shared.count() >= f.edges().count()
    for name in ("var_cvar", "tail_attr", "roi", "convergence"):
        assert "order_edges" in registry.oracle_sql()[name] and "whole_stock" in registry.oracle_sql()[name]


def test_pressure_adds_up_over_sources(spark):
    scenarios = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 3, 0)], "scenario_id int, supplier_id long, disrupted int")
    edges = spark.createDataFrame([(1, 3, 0.3), (2, 3, 0.3), (1, 4, 0.6)], "src long, dst long, c double")
    found = {(r.scenario_id, r.supplier_id): r.second for r in loss.spread_disruption(scenarios, edges).collect()}
    assert found == {(1, 1): 1, (1, 2): 1, (1, 3): 1, (1, 4): 1, (2, 1): 1, (2, 3): 0, (2, 4): 1}


def test_orders_joined_within_their_key(spark):
    """The same rows as by the purchase order alone, repeats and unknown ones included."""
    events = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("c", 2), (None, 2), ("x", 3)], "purchase_order_id string, k long")
    for name in ("raw_status", "carrier_type", "cargo_value_usd"):
        events = events.withColumn(name, F.lit("DL"))
    events = events.withColumns({c: F.lit(D0) for c in ("expected_delivery_date", "actual_delivery_date")})
    orders = spark.createDataFrame([("a", 1, 7), ("a", 1, 8), ("b", 1, 9), ("c", 2, 5), (None, 2, 6)], "purchase_order_id string, k long, supplier_id long").withColumns({"sku_id": F.lit(1), "order_quantity": F.lit(1.0), "unit_cost_usd": F.lit(1.0), "incoterm": F.lit("fob")})
    rows = lambda df: sorted(((r.purchase_order_id, r.supplier_id, r.order_value_usd, r.dq_score) for r in df.collect()), key=repr)
    assert rows(bronze.shipments(events, orders, "2024-01-02", "k")) == rows(bronze.shipments(events, orders, "2024-01-02"))
    plan = bronze.shipments(Feeds(spark, SMALL).carrier(), Feeds(spark, SMALL).purchase_orders(), "2001-11-05", "l_orderkey")._jdf.queryExecution().optimizedPlan().toString()
    assert "_po" in plan


def test_pressure_is_the_product_of_flows_and_scenarios(spark):
    """Suppliers in several blocks, more scenarios than stand side by side, parallel flows and a repeated row of a scenario."""
    rng = random.Random(3)
    hits = [(w, s, int(rng.random() < 0.3)) for w in range(-5, 1500) for s in rng.sample(range(12), 3)] + [(7, 3, 1)]
    edges = [(rng.randrange(12), rng.randrange(-600, 600), rng.random() / 2) for _ in range(900)] + [(1, 2, 0.2), (1, 2, 0.2)]
    want = {}
    for w, s, hit in hits:
        for a, b, c in edges:
            if hit and a == s:
                want[w, b] = want.get((w, b), 0) + c
    found = loss.under_pressure(spark.createDataFrame(hits, "scenario_id int, supplier_id long, disrupted int"), spark.createDataFrame(edges, "src long, dst long, c double"), 0.5)
    assert sorted((r.scenario_id, r.supplier_id) for r in found.collect()) == sorted(k for k, v in want.items() if round(v, 8) > 0.5)


def test_flows_by_order_are_shuffled_twice(spark):
    """By order, then by source: lines were shuffled three times on each side before, and pairs twice more."""
    edges = Feeds(spark, SMALL).order_edges()
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    lines = [(r.l_orderkey, r.l_suppkey, r.l_extendedprice) for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_extendedprice").collect()]
    of, want = {}, {}
    for o, s, v in lines:
        of.setdefault(o, []).append((s, v))
    for rows in of.values():
        for a, v in rows:
            for b, _ in rows:
                if a != b:
                    want[a, b] = want.get((a, b), 0) + v
    found = {(r.src, r.dst): r.flow_volume for r in edges.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 0.011 for k in want)


def test_shuffles_of_a_stored_table_are_freed(spark):
    files = lambda: sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before = files()
    stored = store(spark.range(1000).repartition(3, "id").groupBy("id").count(), "freed")
    assert files() <= before
    assert stored.count() == 1000


def test_flows_by_part_and_day_are_shuffled_twice(spark):
    """By part and day, then by source; lines were shuffled three times on each side before."""
    edges = Feeds(spark, SMALL).edges()
    assert edges._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    of, want = {}, {}
    for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").collect():
        of.setdefault((r.l_partkey, r.l_shipdate), []).append((r.l_suppkey, r.l_extendedprice))
    for rows in of.values():
        for a, v in rows:
            for b, _ in rows:
                if a != b:
                    want[a, b] = want.get((a, b), 0) + v
    found = {(r.src, r.dst): r.flow_volume for r in edges.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 0.011 for k in want)


def test_edges_are_derived_once_for_a_fit(spark, monkeypatch):
    calls = []
    edges = Feeds.edges
    monkeypatch.setattr(Feeds, "edges", lambda self: calls.append(1) or edges(self))
    rows = registry.queries()["contagion_lr"](spark, SMALL)
    assert len(calls) == 1 and "lineitem" not in "".join(rows.inputFiles())


def test_scores_of_rows_are_those_of_their_keys(spark):
    """Rows keep what they carry, repeated keys are summed as one, and nothing is joined for it."""
    rng = random.Random(5)
    rows = [(i % 190, rng.randrange(9) / 3, rng.random() if rng.random() < 0.9 else None, i) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, a double, b double, own long")
    found = scoring.row_scores(store(scoring.tail_rows(df, df, ["a", "b"], ["k", "own"]), "rows"), "k")
    want = {r.k: r.score for r in scoring.tail_scores(df, "k", "a", "b").collect()}
    assert sorted(r.own for r in found.collect()) == list(range(200))
    assert all(abs(r.score - want[r.k]) < 1e-12 for r in found.collect())
    forest = models.isolation_forest(df, "k", ["a", "b"], trees=5, sample=32, carried=["own", "b"])
    assert forest.columns == ["k", "own", "b", "iso_score"] and {(r.own, r.b) for r in forest.collect()} == {(r[3], r[2] or 0.0) for r in rows}


def test_ensemble_keeps_labels_and_scores_alone(spark, monkeypatch):
    """Shipments with all their columns, and scores joined by order, were stored before."""
    kept = []
    monkeypatch.setattr(learning, "store", lambda df, name: kept.append((name, df.columns)) or store(df, name))
    assert registry.queries()["ensemble_eval"](spark, SMALL).first().n_samples > 0
    assert kept == [("labels", ["po_id", "label"]), ("forest-tails", ["po_id", "iso_score", "_raw"])]
