"""Windows in blocks and as-of merges: equal to plain ones on a table where one supplier has half of all rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, gold, models, silver, training

D0 = dt.date(2001, 1, 1)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        supplier = "hot" if i < 1500 else f"s{i % 40}"
        day = D0 + dt.timedelta(days=rng.randint(0, 60) if supplier == "hot" else rng.randint(0, 300))
        if supplier == "hot" and i < 400:
            day = D0 + dt.timedelta(days=20)  # more rows in a day than a block has
        delay = None if rng.random() < 0.03 else float(rng.randint(-5, 9))
        rows.append((supplier, day, f"p{i:05d}", int((delay or 0) <= 0 and rng.random() < 0.97), delay, int(rng.random() < 0.02)))
    rows += [("nulls", None, "n1", 1, 1.0, 0), ("nulls", None, "n2", 0, 2.0, 1), ("nulls", D0, "n3", 1, 3.0, 0)]
    return spark.createDataFrame(rows, "supplier_id string, event_date date, purchase_order_id string, on_time int, delay_days double, disrupted int").repartition(5).cache()


def same(a, b):
    columns = a.columns
    plain = lambda df: sorted((tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()), key=repr)
    assert plain(a) == plain(b)


@pytest.mark.parametrize("run", [silver.rolling, silver.streak, silver.trend, silver.exact_ewm, lambda df, **o: silver.last_disruption(df, "2002-01-01", **o)], ids=["rolling", "streak", "trend", "ewm", "last"])
def test_blocks_equal_whole_histories(skewed, run):
    for size in (100, 333):
        same(run(skewed), run(skewed, block_rows=size))


def test_sums_over_days_equal_row_windows(skewed):
    from pyspark.sql.window import Window

    w = Window.partitionBy("supplier_id").orderBy(F.unix_date("event_date")).rangeBetween(-89, 0)
    dated = skewed.filter("event_date is not null")
    same(silver.rolling_days(dated), dated.withColumns({"events_90d": F.count("*").over(w), "on_time_rate_90d": F.avg(F.col("on_time").cast("double")).over(w)}))
    orders = dated.select("supplier_id", F.col("event_date").alias("order_date"), F.col("on_time").alias("on_time_flag"), "delay_days", F.col("purchase_order_id").alias("order_id"))
    w = Window.partitionBy("supplier_id").orderBy(F.unix_date("order_date")).rangeBetween(-90, 0)
    want = orders.withColumns({"order_volume": F.count("*").over(w), "on_time_rate": F.avg(F.col("on_time_flag").cast("double")).over(w), "order_delay": F.avg("delay_days").over(w)})
    same(gold.order_history(orders), want)


def test_blocks_are_even(skewed):
    found = blocks.Blocks(skewed, "supplier_id", "event_date", 50, 100)
    sizes = sorted(r["count"] for r in found.rows.filter("supplier_id = 'hot'").groupBy("_block").count().collect())
    assert found.rows.filter("_own").count() == skewed.count()
    # a day is never cut, so the day of 400 rows is the largest block; its neighbours see it whole as their halo
    own = sorted(r["count"] for r in found.rows.filter("_own and supplier_id = 'hot'").groupBy("_block").count().collect())
    assert len(own) >= 8 and own[len(own) // 2] <= 200 and own[-2] <= 250 and sizes[len(sizes) // 2] <= 400
    with pytest.raises(ValueError):
        blocks.day_blocks(skewed, "supplier_id", "event_date", 10, 20)


@pytest.mark.parametrize("including", [False, True])
@pytest.mark.parametrize("after", [False, True])
def test_as_of_equals_brute_force(spark, including, after):
    rng = random.Random(7)
    day = lambda: None if rng.random() < 0.05 else D0 + dt.timedelta(days=rng.randint(0, 30))
    key = lambda: None if rng.random() < 0.05 else rng.choice(["hot"] * 5 + ["a", "b", "c"])
    left = [(key(), day(), i) for i in range(200)]
    right = [(key(), day(), i, rng.choice([None, i])) for i in range(300)]
    a = spark.createDataFrame(left, "k string, at date, id int")
    b = spark.createDataFrame(right, "k string, on date, n int, v int")

    def want(k, at):
        if k is None or at is None:
            return None
        fits = [r for r in right if r[0] == k and r[1] is not None and ((r[1] > at if after else r[1] < at) or including and r[1] == at)]
        return (min if after else max)(fits, key=lambda r: (r[1], r[2]), default=(None,) * 4)[2:]

    for size in (20, blocks.BLOCK_ROWS):
        found = blocks.as_of(a, b, "k", "at", "on", ["n", "v"], ["n"], including, after, size)
        assert {r.id: (r.n, r.v) for r in found.collect()} == {i: want(k, at) or (None, None) for k, at, i in left}


def test_as_of_empty_sides(spark):
    a, b = spark.createDataFrame([], "k string, at date"), spark.createDataFrame([], "k string, on date, v int")
    assert blocks.as_of(a, b, "k", "at", "on", ["v"]).collect() == []
    one = spark.createDataFrame([("x", D0)], "k string, at date")
    assert blocks.as_of(one, b, "k", "at", "on", ["v"]).collect()[0].v is None


SHIP = "purchase_order_id string, supplier_id string, event_date date, delay_days double, canonical_status string, origin_port string, destination_port string, cargo_value_usd double, dq_score double"


@pytest.fixture(scope="module")
def feeds(spark):
    """Suppliers x and y; y's disruptions follow late deliveries, x has none."""
    rng = random.Random(3)
    ships = []
    for i in range(500):
        supplier = rng.choice("xy")
        day = D0 + dt.timedelta(days=i)
        ships.append((f"p{i:04d}", supplier, day, float(rng.randint(-3, 6)), "EXCEPTION" if supplier == "y" and rng.random() < 0.1 else "DELIVERED", rng.choice("ab"), rng.choice("cd"), 10.0, 1.0))
    geo = [("C" + s, D0 + dt.timedelta(days=i), i / 500, i / 1000, 0.1, 0.2, 0.3) for i in range(0, 500, 9) for s in "xy"]
    suppliers = [("x", "Cx", 100.0, 40.0, 1.0), ("y", "Cy", 300.0, 90.0, 0.8), ("low", "Cy", 1.0, 1.0, 0.5), ("new", "none", None, None, 0.9)]
    return (
        spark.createDataFrame(suppliers, "supplier_id string, country_code string, annual_spend_usd double, financial_score_ext double, dq_score double"),
        spark.createDataFrame(ships, SHIP),
        spark.createDataFrame(geo, "country_code string, event_date date, geo_score double, instability double, trade_score double, port_score double, volatility double"),
    )


def test_training_rows_know_nothing_of_their_future(spark, feeds):
    """A row is the same if everything from its cut-off on is removed, but for the label, which is the same if all before is."""
    suppliers, ships, geo = feeds
    cuts = training.cutoffs(ships)
    assert [r.cutoff for r in cuts.orderBy("cutoff").collect()][:2] == [dt.date(2001, 2, 1), dt.date(2001, 3, 1)]
    whole = training.point_in_time(suppliers, ships, geo, cuts).cache()
    assert whole.count() == 3 * cuts.count() and {r.supplier_id for r in whole.collect()} == {"x", "y", "new"}
    for cut in ("2001-02-01", "2001-08-01", "2002-03-01"):
        one = spark.createDataFrame([(cut,)], "c string").select(F.col("c").cast("date").alias("cutoff"))
        row = whole.filter(F.col("cutoff") == cut)
        past = training.point_in_time(suppliers, ships.filter(F.col("event_date") < cut), geo.filter(F.col("event_date") < cut), one)
        same(row.drop("label"), past.drop("label"))
        future = training.point_in_time(suppliers, ships.filter(F.col("event_date") >= cut), geo, one)
        same(row.select("supplier_id", "label"), future.select("supplier_id", "label"))
        hits = {r.supplier_id for r in ships.filter(f"canonical_status = 'EXCEPTION' and event_date >= '{cut}' and event_date < date_add('{cut}', 30)").collect()}
        assert {r.supplier_id for r in row.filter("label = 1").collect()} == hits & {"x", "y"}
    new = whole.filter("supplier_id = 'new'").first()
    assert new.on_time_rate_90 == 1.0 and new.days_since_disruption == 365 and new.geo_score == 0.3 and new.label == 0


def test_split_by_time_and_a_model_that_learns(spark, feeds):
    whole = training.point_in_time(*feeds, training.cutoffs(feeds[1]))
    early, late = training.time_split(whole, "cutoff")
    a, b = (df.agg(F.min("cutoff"), F.max("cutoff")).first() for df in (early, late))
    assert a[1] + dt.timedelta(days=30) <= b[0]
    names = ["disruption_rate_90", "days_since_disruption", "financial_risk"]
    model = models.boosted(models.assemble(early, names), "label", rounds=5)
    scores = models.probability(model, models.assemble(late, names))
    means = {r.supplier_id: r.p for r in scores.groupBy("supplier_id").agg(F.avg("p").alias("p")).collect()}
    assert means["y"] > 0.6 > 0.4 > means["x"]


@pytest.mark.parametrize("pane_rows", [5, blocks.BLOCK_ROWS])
def test_history_by_panes_equals_the_windows_of_all_events(spark, pane_rows):
    """Null days and delays, ties of a day, suppliers that pause for months, panes of one day: the values are those of the row-wise windows."""
    rng = random.Random(11)
    day = lambda k: None if rng.random() < 0.02 else D0 + dt.timedelta(days=rng.choice((rng.randrange(400), rng.randrange(3) + 200)) if k != "rare" else 40 * rng.randrange(10))
    late = lambda: rng.choice([None, 0.0, -1.5, 2.25, -3.0, 0.5])
    keys = ["much"] * 400 + ["some"] * 60 + ["rare"] * 5 + ["none"] * 2
    rows = [(f"p{i:04d}", k, day(k), None if k == "none" else late(), rng.choice(["EXCEPTION", "DELIVERED", "DELIVERED"]), rng.choice("ab"), rng.choice("cd"), 1.0, 1.0) for i, k in enumerate(keys)]
    ships = spark.createDataFrame(rows, SHIP)
    cuts = training.cutoffs(ships)
    events = silver.events(ships)
    past = training.history(events, cuts, pane_rows).cache()
    if pane_rows > 5:  # a row per supplier and time between cut-offs
        assert past.groupBy("supplier_id", F.trunc("event_date", "month")).count().filter("count > 1").isEmpty()
    left = spark.createDataFrame([(k,) for k in set(keys)], "supplier_id string").crossJoin(cuts)
    found = blocks.as_of(left, past, "supplier_id", "cutoff", "event_date", training.HISTORY)
    by_row = silver.streak(silver.last_disruption(silver.rolling(events), "1970-01-01"))
    want = blocks.as_of(left, by_row, "supplier_id", "cutoff", "event_date", training.HISTORY, ["purchase_order_id"])
    close = lambda a, b: a == b or a is not None and b is not None and abs(a - b) < 1e-9
    a, b = (sorted(df.collect(), key=lambda r: (r.supplier_id, r.cutoff)) for df in (found, want))
    assert len(a) == len(b) > 30
    for x, y in zip(a, b, strict=True):
        for c in x.asDict():
            assert close(x[c], y[c]) if isinstance(y[c], float) else x[c] == y[c], (c, x, y)


def test_rolling_sums_equal_windows_row_by_row(spark, skewed):
    """Whole and broken days, nulls and days so many that their squares pass 2^63 in sum; no frame of 90 rows is summed anew for each row."""
    from pyspark.sql.window import Window

    last = lambda n: Window.partitionBy("supplier_id").orderBy(*silver.ORDER).rowsBetween(1 - n, 0)
    ok, delay, bad = F.col("on_time").cast("double"), F.col("delay_days"), F.col("disrupted")
    far = F.when(F.col("purchase_order_id") < "p01500", 2000000000 + F.col("delay_days")).otherwise(F.col("delay_days"))
    gaps = F.when(F.xxhash64("purchase_order_id") % 3 != 0, F.col("on_time"))
    for df in (skewed, skewed.withColumn("delay_days", F.col("delay_days") + 0.25), skewed.withColumn("delay_days", far.cast("int")), skewed.withColumn("on_time", gaps).withColumn("delay_days", F.col("delay_days").cast("int"))):
        want = {f"on_time_rate_{n}": F.avg(ok).over(last(n)) for n in (7, 30, 90)} | {f"delay_mean_{n}": F.avg(delay).over(last(n)) for n in (30, 90)}
        want |= {"delay_std_90": F.round(F.stddev(delay.cast("decimal(20,2)") % 1000).over(last(90)), 6), "disruptions_90": F.sum(bad).over(last(90)), "total_90": F.count("*").over(last(90))}
        found = silver.rolling(df).withColumn("delay_std_90", F.round("delay_std_90", 6)).select(*df.columns, *want)
        near = df.withColumns(want).select(*found.columns)
        if df.schema["delay_days"].dataType.simpleString() == "int":
            assert "specifiedwindowframe(RowFrame, -89" not in silver.rolling(df)._jdf.queryExecution().optimizedPlan().toString()
        hot = df.groupBy("supplier_id").agg(F.max("delay_days").alias("m")).filter("m > 1000").select("supplier_id")  # numbers of both kinds: Spark's own are rounded
        same(near.join(hot, "supplier_id", "left_anti").drop("delay_std_90"), found.join(hot, "supplier_id", "left_anti").drop("delay_std_90"))
    exact = silver.rolling(skewed.filter("supplier_id = 'hot'").withColumn("delay_days", (2000000000 + F.col("delay_days")).cast("int"))).select("purchase_order_id", F.round("delay_std_90", 9).alias("s"))
    close = silver.rolling(skewed.filter("supplier_id = 'hot'").withColumn("delay_days", F.col("delay_days").cast("int"))).select("purchase_order_id", F.round("delay_std_90", 9).alias("s"))
    same(exact, close)


def test_supplier_events_take_running_sums(spark):
    """Their delays are whole numbers, so no frame of 90 events is summed anew for each event."""
    from tidemark.plans.relational import supplier_events
    from tidemark.sources.adapters import Feeds

    plan = silver.rolling(supplier_events(Feeds(spark, "/root/testdata/sf0.001")))._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe(RowFrame, unboundedpreceding" in plan and "specifiedwindowframe(RowFrame, -89" not in plan
