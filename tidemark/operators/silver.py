"""Second layer: supplier and shipment features. Windows over a supplier's events run in blocks (``blocks``), so that no
supplier's history is ordered in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.functions import columns as C
from tidemark.operators.blocks import BLOCK_ROWS, Blocks, blocks_before, over_days

EPS = 1e-9


def events(shipments: DataFrame, least_dq: float = 0.6) -> DataFrame:
    """Shipments of known suppliers that pass the quality gate; a null score does not."""
    return shipments.filter((F.col("dq_score") >= least_dq) & F.col("supplier_id").isNotNull()).withColumns(
        {"on_time": (F.col("delay_days") <= 0).cast("int"), "disrupted": F.coalesce((F.col("canonical_status") == "EXCEPTION").cast("int"), F.lit(0))}
    )


def proxies() -> dict[str, Column]:
    """Columns that follow from the rolling ones."""
    return {
        "disruption_rate_90": F.col("disruptions_90") / (F.col("total_90") + EPS),
        "ewm_proxy": F.col("on_time_rate_30") * 0.2 + F.col("on_time_rate_90") * 0.8,
        "drift_proxy": F.abs(F.col("delay_mean_30") - F.col("delay_mean_90")) / (F.col("delay_mean_90") + EPS),
        "trend_proxy": (F.col("delay_mean_30") - F.col("delay_mean_90")) / 60,
        "lead_time_variance": F.when(F.col("delay_mean_90") > 0, F.col("delay_std_90") / F.col("delay_mean_90")).otherwise(0.0),
    }


ORDER = ("event_date", "purchase_order_id")


def rolling(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rates and delays over the last 7, 30 and 90 events of a supplier.

    A window over whole numbers is a running sum less that of n rows before, so a row costs the same whatever n, and all is
    exact; squares are summed in two halves, so that no number of days overflows. Delays in fractions are summed window by window.
    """
    blocks = Blocks(df, "supplier_id", "event_date", 89, block_rows)
    in_order = blocks.window(*ORDER)
    so_far, last = in_order.rowsBetween(Window.unboundedPreceding, 0), lambda n: in_order.rowsBetween(1 - n, 0)
    whole = isinstance(df.schema["delay_days"].dataType, T.IntegralType)
    ok, delay, bad = (F.col(c).cast("long") for c in ("on_time", "delay_days", "disrupted"))
    high, low = F.shiftright(delay * delay, 31), (delay * delay).bitwiseAND(F.lit((1 << 31) - 1))
    sums = {"ok": (ok, (7, 30, 90)), "bad": (bad, (90,))} | ({"delay": (delay, (30, 90)), "high": (high, (90,)), "low": (low, (90,))} if whole else {})
    running, windows = {"_n": F.count("*").over(so_far)}, {}
    for k, (c, reaches) in sums.items():
        running |= {f"_{k}": F.coalesce(F.sum(c).over(so_far), F.lit(0)), f"_known_{k}": F.count(c).over(so_far)}
        windows |= {f"{name}_{n}": F.col(name) - F.lag(name, n, 0).over(in_order) for name in (f"_{k}", f"_known_{k}") for n in reaches}
    mean = lambda k, n: F.try_divide(F.col(f"_{k}_{n}").cast("double"), F.col(f"_known_{k}_{n}").cast("double"))
    plain = {"delay_mean_30": F.avg("delay_days").over(last(30)), "delay_mean_90": F.avg("delay_days").over(last(90)), "delay_std_90": F.stddev("delay_days").over(last(90))}
    added = {
        "on_time_rate_7": mean("ok", 7),
        "on_time_rate_30": mean("ok", 30),
        "on_time_rate_90": mean("ok", 90),
        **({"delay_mean_30": mean("delay", 30), "delay_mean_90": mean("delay", 90), "delay_std_90": _spread("_known_delay_90", "_delay_90", "_high_90", "_low_90")} if whole else plain),
        "disruptions_90": F.when(F.col("_known_bad_90") > 0, F.col("_bad_90")),
        "total_90": F.least("_n", F.lit(90)),
    }
    return blocks.own(blocks.rows.withColumns(running).withColumns(windows).withColumns(added), *added).withColumns(proxies())


def _spread(count: str, total: str, high: str, low: str) -> Column:
    """Standard deviation from exact sums: ``high`` times 2^31 and ``low`` are that of squares."""
    n, s = F.col(count), F.col(total)
    exact = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    small = n * (F.col(high) * (1 << 31) + F.col(low)) - s * s
    large = (exact(high, 12) * F.lit(1 << 31).cast("decimal(10,0)") + exact(low, 12)) * exact(count, 3) - exact(total, 13) * exact(total, 13)
    return F.when(n > 1, F.sqrt(F.when(F.col(high) < (1 << 20), small.cast("double")).otherwise(large.cast("double")) / (n * (n - 1))))


def rolling_days(df: DataFrame, n: int = 90) -> DataFrame:
    """On-time rate and number of events over the last ``n`` days, today included."""
    ok = F.col("on_time").cast("double")
    found = over_days(df, "supplier_id", "event_date", n - 1, {"_ok": F.sum(ok), "_known": F.count(ok), f"events_{n}d": F.count("*")})
    return found.withColumn(f"on_time_rate_{n}d", F.try_divide("_ok", "_known")).drop("_ok", "_known")


def last_disruption(df: DataFrame, as_of: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    blocks = Blocks(df, "supplier_id", "event_date", 0, block_rows)
    at = F.when(F.col("disrupted") == 1, F.col("event_date"))
    rows = blocks.carried(blocks.rows, {"_last": F.max(at)}, {"_handed": F.max("_last").over(blocks_before("supplier_id"))})
    seen = F.last(at, ignorenulls=True).over(blocks.window(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    found = blocks.own(rows.withColumn("last_disruption", F.coalesce(seen, "_handed")), "last_disruption")
    return found.withColumn("days_since_disruption", F.datediff(F.lit(as_of).cast("date"), "last_disruption"))


def streak(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """On-time events in a row up to each event; a late one is 0. A block begins with what runs on from those before it."""
    blocks = Blocks(df, "supplier_id", "event_date", 0, block_rows)
    so_far = blocks.window(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks.rows.withColumn("_island", F.sum(1 - F.col("on_time")).over(so_far))
    inside = Window.partitionBy(*blocks.by, "_island").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum("on_time").over(inside))
    totals = {"_late": F.max((F.col("on_time") == 0).cast("int")), "_end": F.max_by("_run", F.struct(*ORDER))}
    in_order = Window.partitionBy("supplier_id").orderBy("_block")
    chain = F.sum("_late").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    # runs at the ends of blocks add up from the last block with a late event on
    running = F.sum("_end").over(Window.partitionBy("supplier_id", "_chain").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0))
    handed = blocks.carried_through(rows, totals, [{"_chain": chain}, {"_running": running}, {"_handed": F.lag("_running").over(in_order)}], ["_handed"])
    found = handed.withColumn("on_time_streak", F.col("_run") + F.when(F.col("_island") == 0, F.coalesce("_handed", F.lit(0))).otherwise(0))
    return blocks.own(found, "on_time_streak")


def trend(df: DataFrame, n: int = 90, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Least-squares slope of delay over the day, in the last ``n`` events."""
    blocks = Blocks(df, "supplier_id", "event_date", n - 1, block_rows)
    slope = F.regr_slope("delay_days", F.unix_date("event_date").cast("double")).over(blocks.window(*ORDER).rowsBetween(1 - n, 0))
    return blocks.own(blocks.rows.withColumn("delay_slope", slope), "delay_slope")


def exact_ewm(df: DataFrame, alpha: float = 0.2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exponentially weighted on-time rate of each supplier over all its events, in order.

    The fold of a series is a sum with weights by place: alpha (1 - alpha)^i for the i-th newest event, and the rest of the
    weight for the oldest. So no series is collected, and the sums of blocks add up, each scaled by the events after it.
    """
    blocks = Blocks(df.select("supplier_id", "event_date", "purchase_order_id", "on_time"), "supplier_id", "event_date", 0, block_rows)
    newest = Window.partitionBy(*blocks.by).orderBy(F.col("event_date").desc(), F.col("purchase_order_id").desc())
    placed = blocks.rows.select(*blocks.by, "on_time", F.row_number().over(newest).alias("n"))
    decay = lambda n: F.pow(F.lit(1 - alpha), n)
    sums = placed.groupBy(*blocks.by).agg(F.sum(decay(F.col("n") - 1) * alpha * F.col("on_time")).alias("s"), F.max_by("on_time", "n").alias("oldest"), F.max("n").alias("k"))
    after = F.coalesce(F.sum("k").over(Window.partitionBy("supplier_id").orderBy("_block").rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    whole = sums.withColumn("later", after).groupBy("supplier_id").agg(F.sum(F.col("s") * decay(F.col("later"))).alias("s"), F.min_by("oldest", "_block").alias("oldest"), F.sum("k").alias("k"))
    return whole.select("supplier_id", (F.col("s") + decay(F.col("k") - 1) * (1 - alpha) * F.col("oldest")).alias("ewm"))


def delay_divergence(df: DataFrame, width: int = 5) -> DataFrame:
    """Jensen-Shannon divergence, by supplier, of the delays of the last 30 events and the last 90."""
    newest = Window.partitionBy("supplier_id").orderBy(F.col("event_date").desc(), F.col("purchase_order_id").desc())
    tail = df.withColumn("n", F.row_number().over(newest)).filter("n <= 90").withColumn("bin", F.floor(F.col("delay_days") / width))
    bins = tail.groupBy("supplier_id", "bin").agg(F.sum((F.col("n") <= 30).cast("double")).alias("a"), F.count("*").cast("double").alias("b"))
    whole = Window.partitionBy("supplier_id")
    shares = bins.withColumns({"p": F.col("a") / F.sum("a").over(whole), "q": F.col("b") / F.sum("b").over(whole)})
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)
    return shares.groupBy("supplier_id").agg((F.sum(part(F.col("p")) + part(F.col("q"))) / 2).alias("js"))


def latest(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The latest row of each key in a total order."""
    w = Window.partitionBy(key).orderBy(*(C.col(c).desc() for c in order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def labelled(shipments: DataFrame, least_dq: float = 0.6) -> DataFrame:
    """Shipments past the gate with their disruption label; a null value of cargo and a null delay are 0."""
    label = F.when((F.col("delay_days") > 3) | F.col("canonical_status").isin("EXCEPTION", "CUSTOMS_HOLD"), 1).otherwise(0)
    return shipments.filter(F.col("dq_score") >= least_dq).fillna(0.0, [c for c in ("cargo_value_usd", "delay_days") if c in shipments.columns]).withColumn("label", label)


def route_stats(df: DataFrame, least_rows: int = 10, prior: float = 0.25) -> DataFrame:
    """Statistics of each origin and destination; routes of few rows take the prior risk."""
    stats = df.groupBy("origin_port", "destination_port").agg(
        F.count("*").alias("route_n"), F.avg(F.col("label").cast("double")).alias("route_rate"), F.percentile_approx("delay_days", 0.5, 1_000_000).alias("route_median_delay"),
        F.stddev("delay_days").alias("route_std_delay"), F.avg("cargo_value_usd").alias("route_avg_cargo"),
    )
    return stats.withColumn("route_risk", F.when(F.col("route_n") >= least_rows, F.col("route_rate")).otherwise(prior))


def calendar(df: DataFrame, day: str = "expected_delivery_date") -> DataFrame:
    """Calendar columns of the day that a shipment is expected; a row without one has a sine of 0 and a cosine of 1."""
    month = F.month(day)
    angle = month * (2 * 3.14159265 / 12)
    return df.withColumns(
        {
            "month": month,
            "day_of_week": F.dayofweek(day),
            "quarter": F.quarter(day),
            "is_q4": (month >= 10).cast("int"),
            "is_weekend": F.dayofweek(day).isin(1, 7).cast("int"),
            "month_sin": F.sin(angle),
            "month_cos": F.cos(angle),
        }
    ).fillna({"is_q4": 0, "is_weekend": 0, "month_sin": 0.0, "month_cos": 1.0})


#: What stands for a missing route or supplier value of a shipment, and for one of a supplier.
SHIPMENT_DEFAULTS = {
    "route_risk": 0.25,
    "route_rate": 0.25,
    "route_median_delay": 2.0,
    "route_std_delay": 3.0,
    "route_n": 0,
    "sup_disruption_rate_90": 0.1,
    "sup_on_time_rate_90": 0.9,
    "sup_geo_score": 0.3,
    "sup_financial_risk": 0.3,
    "sup_network_pagerank": 0.01,
}
SUPPLIER_DEFAULTS = {
    "on_time_rate_7": 1.0,
    "on_time_rate_30": 1.0,
    "on_time_rate_90": 1.0,
    "ewm_proxy": 1.0,
    "delay_mean_30": 0.0,
    "delay_mean_90": 0.0,
    "delay_std_90": 0.0,
    "drift_proxy": 0.0,
    "disruption_rate_90": 0.0,
    "days_since_disruption": 365,
    "on_time_streak": 30,
    "lead_time_variance": 0.0,
    "trend_proxy": 0.0,
    "geo_score": 0.3,
    "instability": 0.3,
    "trade_score": 0.0,
    "port_score": 0.0,
    "volatility": 0.0,
    "financial_risk": 0.3,
    "payment_delay_proxy": 0.0,
    "network_pagerank": 0.01,
    "betweenness_centrality": 0.0,
    "second_order_contagion_score": 0.0,
    "supply_concentration_hhi": 0.0,
    "transit_route_risk": 0.0,
    "order_volume_30": 0.0,
    "order_volume_90": 0,
}


def shipment_features(shipments: DataFrame, features: DataFrame, exclude_current: bool = False, routes: DataFrame | None = None) -> DataFrame:
    """Calendar, mode, cargo and route features, and five of the supplier's (``features``, a row a supplier).

    ``exclude_current`` leaves a row out of its own route's rate. ``routes`` are the :func:`route_stats` of these
    shipments, where they are there already.
    """
    base = labelled(shipments)
    joined = calendar(base).join(route_stats(base) if routes is None else routes, ["origin_port", "destination_port"], "left")
    if exclude_current:
        others = (F.col("route_rate") * F.col("route_n") - F.col("label")) / (F.col("route_n") - 1)
        joined = joined.withColumn("route_risk", F.when(F.col("route_n") > 10, others).otherwise(0.25))
    names = ("disruption_rate_90", "on_time_rate_90", "geo_score", "financial_risk", "network_pagerank")
    context = features.select("supplier_id", *((F.col(c) if c in features.columns else F.lit(None).cast("double")).alias(f"sup_{c}") for c in names))
    modes = {f"is_{m.lower()}": (F.col("transport_mode") == m).cast("int") for m in ("OCEAN", "AIR_PARCEL", "TRUCK")}
    return joined.withColumns({**modes, "log_cargo": F.log1p("cargo_value_usd")}).join(context, "supplier_id", "left").fillna(SHIPMENT_DEFAULTS)


def newest_values(df: DataFrame, as_of: str) -> DataFrame:
    """One row per supplier: what the row-wise windows above hold at its newest event.

    Rates come from the newest 90 events, a limited rank that is applied before the shuffle as well; the last disruption
    and the events since the last late one from partial aggregates. No supplier's whole history is ordered in a task.
    """
    order = F.struct("event_date", "purchase_order_id")
    newest = Window.partitionBy("supplier_id").orderBy(F.col("event_date").desc(), F.col("purchase_order_id").desc())
    df = df.select("supplier_id", "event_date", "purchase_order_id", "on_time", "delay_days", "disrupted", "origin_port", "destination_port")
    tail = df.withColumn("n", F.row_number().over(newest)).filter("n <= 90")
    last = lambda n, c: F.when(F.col("n") <= n, F.col(c).cast("double"))
    rates = tail.groupBy("supplier_id").agg(
        *(F.avg(last(n, "on_time")).alias(f"on_time_rate_{n}") for n in (7, 30, 90)),
        *(F.avg(last(n, "delay_days")).alias(f"delay_mean_{n}") for n in (30, 90)),
        F.stddev(last(90, "delay_days")).alias("delay_std_90"),
        F.sum("disrupted").alias("disruptions_90"),
        F.count("*").alias("total_90"),
        *(F.max_by(c, order).alias(f"last_{c}") for c in ("origin_port", "destination_port")),
    )
    marks = df.groupBy("supplier_id").agg(F.max(F.when(F.col("disrupted") == 1, F.col("event_date"))).alias("last_disruption"), F.max(F.when(F.col("on_time") == 0, order)).alias("late"))
    since = df.join(marks.select("supplier_id", "late"), "supplier_id").filter(F.col("late").isNull() | (order > F.col("late")))
    streaks = since.groupBy("supplier_id").agg(F.count("*").alias("on_time_streak"))
    joined = rates.join(marks.drop("late"), "supplier_id").join(streaks, "supplier_id", "left").fillna({"on_time_streak": 0})
    return joined.withColumn("days_since_disruption", F.datediff(F.lit(as_of).cast("date"), "last_disruption")).withColumns(proxies())


def supplier_features(suppliers: DataFrame, shipments: DataFrame, geo: DataFrame, centrality: DataFrame | None = None, as_of: str | None = None, routes: DataFrame | None = None) -> DataFrame:
    """One row per supplier past the gate of 0.7: its latest window values, its country's latest risk, its network scores.

    ``centrality`` has a row a supplier, ``routes`` are the :func:`route_stats` of the shipments, where they are there already. The route risk is that of the latest shipment's route; the shares of spend are of
    all suppliers here. Missing values are those of ``SUPPLIER_DEFAULTS``.
    """
    now = newest_values(events(shipments), as_of or str(shipments.sparkSession.sql("select current_date()").first()[0]))
    routes = (route_stats(labelled(shipments)) if routes is None else routes).select(F.col("origin_port").alias("last_origin_port"), F.col("destination_port").alias("last_destination_port"), F.col("route_risk").alias("transit_route_risk"))
    now = now.join(routes, ["last_origin_port", "last_destination_port"], "left")
    country = latest(geo, "country_code", "event_date").select("country_code", "geo_score", "geo_risk_tier", "instability", "trade_score", "port_score", "volatility")
    joined = suppliers.filter("dq_score >= 0.7").join(now, "supplier_id", "left").join(country, "country_code", "left")
    if centrality is not None:
        joined = joined.join(centrality, "supplier_id", "left")
    spend = F.greatest(F.coalesce("annual_spend_usd", F.lit(0.0)), F.lit(0.0))
    joined = joined.crossJoin(F.broadcast(suppliers.agg(F.sum(spend).alias("all_spend")))).withColumns(
        {
            "financial_risk": 1 - F.col("financial_score_ext") / 100,
            "payment_delay_proxy": F.coalesce(F.col("delay_mean_90") / 30, F.lit(0.0)),
            "order_volume_30": F.col("total_90") / 3,
            "order_volume_90": F.col("total_90"),
            "spend_share_pct": F.try_divide(spend, F.col("all_spend")) * 100,
        }
    )
    filled = joined.fillna({k: v for k, v in SUPPLIER_DEFAULTS.items() if k in joined.columns})
    return filled.withColumn("political_stability", 2.5 - 5 * F.col("instability")).drop("all_spend")
