"""The training set of the risk classifier: what was known of a supplier at a cut-off, and what came in the days after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import silver
from tidemark.operators.blocks import BLOCK_ROWS, as_of
from tidemark.sources.stored import store

#: Values of a supplier's events that are carried to a cut-off.
HISTORY = [
    "on_time_rate_7", "on_time_rate_30", "on_time_rate_90", "ewm_proxy", "delay_mean_30", "delay_mean_90", "delay_std_90", "drift_proxy", "disruption_rate_90", "lead_time_variance", "trend_proxy", "on_time_streak", "last_disruption", "total_90",
    "origin_port", "destination_port",
]
COUNTRY = ["geo_score", "instability", "trade_score", "port_score", "volatility"]


def cutoffs(shipments: DataFrame, horizon: int = 30, day: str = "event_date") -> DataFrame:
    """The first day of each month that has a shipment before it and ``horizon`` days of shipments after it."""
    span = shipments.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    first, last = F.add_months(F.trunc("a", "month"), 1), F.trunc(F.date_sub("b", horizon - 1), "month")
    months = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month")))
    return span.select(F.explode(months).alias("cutoff"))


def route_history(labelled: DataFrame) -> DataFrame:
    """Per route and day: shipments and labels up to that day, its own included. Routes are ordered by day, not by row."""
    days = labelled.filter(F.col("event_date").isNotNull()).groupBy(F.concat_ws("|", "origin_port", "destination_port").alias("route"), "event_date").agg(F.count("*").alias("n"), F.sum("label").alias("hits"))
    so_far = Window.partitionBy("route").orderBy("event_date").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("route", "event_date", F.sum("n").over(so_far).alias("route_n"), F.sum("hits").over(so_far).alias("route_hits"))


def history(events: DataFrame, cuts: DataFrame, pane_rows: int = BLOCK_ROWS) -> DataFrame:
    """What the windows of :mod:`silver` hold at a supplier's newest event before each cut-off, without a window over its other events.

    A pane is the time from a cut-off to the next. supplier_id, event_date (the pane's last day with an event), the values of
    ``HISTORY`` at its newest event, first_hit (day of its first disruption); a row per supplier and pane with events. A pane keeps its newest 90 events, its counts and the on-time events
    since its last late one; rates are taken over the panes that the last 90 events lie in. A pane of a supplier with more than
    ``pane_rows`` events is cut into days, so neither a supplier's nor a large pane's events are ordered in one task.
    """
    rows = events.select("supplier_id", "event_date", "purchase_order_id", "on_time", "delay_days", "disrupted", "origin_port", "destination_port")
    days = rows.select(F.col("event_date").alias("_day")).distinct().join(F.broadcast(cuts), F.col("cutoff") <= F.col("_day"), "left").groupBy("_day").agg(F.max("cutoff").alias("pane"))
    rows = rows.join(F.broadcast(store(days.filter("pane is not null"), "panes")), F.col("event_date") == F.col("_day"), "left").drop("_day")
    large = store(rows.groupBy("supplier_id", "pane").agg(F.count("*").alias("n")).filter(F.col("n") > pane_rows).select(F.col("supplier_id").alias("_s"), F.col("pane").alias("_p")), "large-panes")
    if large.isEmpty():
        rows = rows.withColumn("part", F.lit(None).cast("date"))
    else:
        rows = rows.join(large, (F.col("supplier_id") == F.col("_s")) & F.col("pane").eqNullSafe(F.col("_p")), "left")
        rows = rows.withColumn("part", F.when(F.col("_s").isNotNull(), F.col("event_date"))).drop("_s", "_p")
    by = ["supplier_id", "pane", "part"]
    newest = Window.partitionBy(*by).orderBy(F.col("event_date").desc(), F.col("purchase_order_id").desc())
    late = (F.col("on_time") == 0).cast("int")
    placed = rows.withColumns({"n": F.row_number().over(newest), "late_since": F.coalesce(F.sum(late).over(newest.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))})
    hit = F.when(F.col("disrupted") == 1, F.col("event_date"))
    panes = placed.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count("on_time").alias("known"), F.coalesce(F.max(late), F.lit(0)).alias("late"), F.coalesce(F.sum(F.when(F.col("late_since") == 0, F.col("on_time"))), F.lit(0)).alias("run"),
        F.max("event_date").alias("last_day"), F.max(hit).alias("last_hit"), F.min(hit).alias("first_hit"), *(F.max(F.when(F.col("n") == 1, F.col(c))).alias(c) for c in ("origin_port", "destination_port")),
        F.array_sort(F.collect_list(F.when(F.col("n") <= 90, F.struct((-F.col("n")).alias("place"), "on_time", "delay_days", "disrupted")))).alias("tail"),
    )
    in_order = Window.partitionBy("supplier_id").orderBy("pane", "part")
    panes = panes.withColumns({c: F.sum(s).over(in_order) for c, s in {"upto": "rows", "seen": "known", "chain": "late"}.items()} | {"last_disruption": F.max("last_hit").over(in_order)})
    # runs of whole panes add up from the last pane with a late event on
    panes = panes.withColumn("on_time_streak", F.when(F.col("seen") > 0, F.sum("run").over(Window.partitionBy("supplier_id", "chain").orderBy("pane", "part"))))
    reach = Window.partitionBy("supplier_id").orderBy("upto").rangeBetween(-89, 0)
    panes = panes.withColumn("tail", F.flatten(F.collect_list("tail").over(reach)))
    last = panes.withColumn("tail", F.when(F.size("tail") > 90, F.slice("tail", -90, 90)).otherwise(F.col("tail")))
    kept = ["supplier_id", "upto", "last_day", "on_time_streak", "last_disruption", "first_hit", "origin_port", "destination_port"]
    each = last.filter("last_day is not null").select(*kept, F.size("tail").alias("size"), F.posexplode("tail").alias("at", "e")).select(*kept, (F.col("size") - F.col("at")).alias("n"), "e.*")
    of = lambda n, c: F.when(F.col("n") <= n, F.col(c).cast("double"))
    rates = each.groupBy(*kept).agg(
        *(F.avg(of(n, "on_time")).alias(f"on_time_rate_{n}") for n in (7, 30, 90)),
        *(F.avg(of(n, "delay_days")).alias(f"delay_mean_{n}") for n in (30, 90)),
        F.stddev("delay_days").alias("delay_std_90"), F.sum("disrupted").alias("disruptions_90"), F.count("*").alias("total_90"),
    )
    return rates.withColumns(silver.proxies()).withColumnRenamed("last_day", "event_date").select("supplier_id", "event_date", *HISTORY, "first_hit")


def shared_as_of(rows: DataFrame, right: DataFrame, key: str, values: list[str], name: str) -> DataFrame:
    """As :func:`blocks.as_of` at the cut-offs of ``rows``; values that all rows of a key and cut-off share are found once."""
    found = store(as_of(rows.select(key, "cutoff").distinct(), right, key, "cutoff", "event_date", values), name)
    return rows.join(found, [key, "cutoff"], "left")


def point_in_time(suppliers: DataFrame, shipments: DataFrame, geo: DataFrame, cuts: DataFrame, horizon: int = 30, least_rows: int = 10, prior: float = 0.25) -> DataFrame:
    """One row per supplier past the gate of 0.7 and cut-off: features of the days before, label of the ``horizon`` days from it on.

    supplier_id, cutoff, label, the features of :func:`silver.supplier_features` that have a history, financial risk and share of
    spend, which the master holds without dates. Every dated value comes from a row before the cut-off, by as-of merges: the
    supplier's windows from its newest event, its country's scores from the newest day, its latest route's risk from the shipments of
    that route so far. The label is 1 if the first disrupted shipment (status EXCEPTION) from the cut-off on comes within the horizon. Missing
    values are those of ``silver.SUPPLIER_DEFAULTS``.
    """
    spend = F.greatest(F.coalesce("annual_spend_usd", F.lit(0.0)), F.lit(0.0))
    share = F.try_divide(spend, F.sum(spend).over(Window.partitionBy())) * 100
    known = suppliers.withColumn("spend_share_pct", share) if "spend_share_pct" not in suppliers.columns else suppliers
    known = known.filter("dq_score >= 0.7").select("supplier_id", "country_code", (1 - F.col("financial_score_ext") / 100).alias("financial_risk"), "spend_share_pct")
    rows = known.crossJoin(F.broadcast(cuts))
    # a merge reads its input twice, so what it rests on is stored; these tables have a row per supplier and cut-off
    past = store(history(silver.events(shipments), cuts), "history")
    rows = store(as_of(rows, past, "supplier_id", "cutoff", "event_date", HISTORY), "with-history")
    hits = past.filter("first_hit is not null").select("supplier_id", F.col("first_hit").alias("event_date"), F.col("first_hit").alias("next_hit"))
    rows = as_of(rows, hits, "supplier_id", "cutoff", "event_date", ["next_hit"], including=True, after=True)
    rows = store(rows.withColumn("route", F.concat_ws("|", "origin_port", "destination_port")), "with-hits")
    rows = shared_as_of(rows, geo, "country_code", COUNTRY, "country-at")
    rows = shared_as_of(rows, route_history(silver.labelled(shipments)), "route", ["route_n", "route_hits"], "route-at")
    rows = rows.withColumns(
        {
            "label": F.coalesce((F.datediff("next_hit", "cutoff") < horizon).cast("int"), F.lit(0)),
            "days_since_disruption": F.datediff("cutoff", "last_disruption"),
            "transit_route_risk": F.when(F.col("route_n") >= least_rows, F.col("route_hits") / F.col("route_n")).when(F.col("route_n").isNotNull(), prior),
            "payment_delay_proxy": F.col("delay_mean_90") / 30,
            "order_volume_30": F.col("total_90") / 3,
            "order_volume_90": F.col("total_90"),
        }
    )
    filled = rows.fillna({k: v for k, v in silver.SUPPLIER_DEFAULTS.items() if k in rows.columns})
    found = filled.withColumn("political_stability", 2.5 - 5 * F.col("instability"))
    return found.drop("country_code", "route", "route_n", "route_hits", "next_hit", "origin_port", "destination_port", "last_disruption", "total_90")


def time_split(df: DataFrame, time: str, share: float = 0.8, gap: int = 30) -> tuple[DataFrame, DataFrame]:
    """Rows of the first ``share`` of the times and those of the rest; the first part lacks those whose ``gap`` days reach into the second."""
    times = store(df.select(time).distinct(), "times")
    order = Window.orderBy(time)  # a row per time
    first = times.withColumns({"k": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy())}).filter(F.col("k") > F.col("n") * share).agg(F.min(time).alias("_from"))
    marked = df.crossJoin(F.broadcast(first))
    return marked.filter(F.date_add(time, gap) <= F.col("_from")).drop("_from"), marked.filter(F.col(time) >= F.col("_from")).drop("_from")
