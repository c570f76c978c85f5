"""Third layer: one risk row per supplier, lookups and reports on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import columns as C
from tidemark.operators.blocks import over_days
from tidemark.operators.ranks import quantiles
from tidemark.operators.silver import latest


def order_history(orders: DataFrame) -> DataFrame:
    """On-time rate, mean delay and number of a supplier's orders in the last 90 days before each one, its day included."""
    on_time, sums = F.col("on_time_flag").cast("double"), {}
    for name, value in (("_ok", on_time), ("_delay", F.col("delay_days"))):
        sums |= {name: F.sum(value), f"{name}_n": F.count(value)}
    found = over_days(orders, "supplier_id", "order_date", 90, sums | {"order_volume": F.count("*")})
    return found.withColumns({"on_time_rate": F.try_divide("_ok", "_ok_n"), "order_delay": F.try_divide("_delay", "_delay_n")}).drop(*sums)


def shipment_totals(shipments: DataFrame) -> DataFrame:
    bad = F.sum(F.col("status").isin("DELAYED", "LOST").cast("int"))
    totals = shipments.groupBy("supplier_id").agg(F.avg("delay_days").alias("mean_delay"), F.stddev("delay_days").alias("std_delay"), bad.alias("disruptions"), F.count("*").alias("n_shipments"))
    return totals.withColumn("disruption_rate", F.try_divide(F.col("disruptions").cast("double"), F.col("n_shipments")))


def risk_master(suppliers: DataFrame, shipments: DataFrame, geo: DataFrame, orders: DataFrame) -> DataFrame:
    """Composite score and tier: each side is reduced to one row per key first, so suppliers stay unique.

    ``disruption_probability`` is that of a disrupted shipment in the next 30 days, if as many come as in a third of the last 90 days
    and each is disrupted as often as those so far.
    """
    now = latest(order_history(orders), "supplier_id", "order_date", "order_id").select("supplier_id", "on_time_rate", "order_delay", "order_volume")
    country = latest(geo, "country_code", "event_date").select("country_code", "geo_score")
    joined = suppliers.join(shipment_totals(shipments), "supplier_id", "left").join(country, "country_code", "left").join(now, "supplier_id", "left")
    joined = joined.withColumns(
        {
            "financial_risk": 1 - F.col("financial_score_ext") / 100,
            "concentration_risk": F.col("order_volume") / 1000,
            "lead_time_variance": F.col("std_delay") / (F.col("mean_delay") + 1e-6),
            "late_rate": 1 - F.col("on_time_rate"),
            "disruption_probability": C.rounded(1 - F.pow(1 - F.col("disruption_rate"), F.col("order_volume") / 3), 6),
        }
    )
    score = C.weighted(geo_score=0.30, disruption_rate=0.25, late_rate=0.20, lead_time_variance=0.15, financial_risk=0.10)
    return joined.withColumn("composite", C.rounded(score, 6)).withColumn("risk_tier", C.gold_tier("composite"))


def top(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first n rows in a total order: a bounded sort in each task, then one of n rows a task."""
    return df.orderBy(*order).limit(n)


def lookup(df: DataFrame, where: dict[str, dict | object], properties: list[str], order: list[Column], limit: int) -> DataFrame:
    """A declared lookup: conditions by column ($gte, $lt, $in or a value), columns, order, limit."""
    tests = {"$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$in": lambda c, v: c.isin(*v)}
    for column, test in where.items():
        for op, value in (test if isinstance(test, dict) else {"$in": [test]}).items():
            df = df.filter(tests[op](F.col(column), value))
    return df.orderBy(*order).limit(limit).select(*properties)


def tier_counts(df: DataFrame) -> DataFrame:
    """Suppliers by tier, with 0 for absent ones."""
    tiers = df.sparkSession.createDataFrame([(t,) for t in ("CRITICAL", "HIGH", "MEDIUM", "LOW")], "risk_tier string")
    return tiers.join(df.groupBy("risk_tier").agg(F.count("*").alias("n")), "risk_tier", "left").fillna({"n": 0})


def subtotals(df: DataFrame, *by: str) -> DataFrame:
    """Rows, late rows and late rate for all values of ``by``, and for each of its prefixes down to the grand total.

    ``level`` counts the columns that a row sums over; those are null.
    """
    rolled = df.rollup(*by).agg(F.grouping_id().alias("mask"), F.count("*").alias("n"), F.sum("is_late").alias("late"), F.avg(F.col("is_late").cast("double")).alias("late_rate"))
    return rolled.withColumn("level", F.bit_count("mask")).drop("mask")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int, by: list[str] | None = None) -> DataFrame:
    """Equal-width counts, for each value of ``by``; the last bin is closed."""
    at = F.least(F.floor((F.col(column) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(column).between(low, high)).groupBy(*(by or []), at.alias("bin")).agg(F.count("*").alias("n"))


def profile(df: DataFrame, *features: str) -> DataFrame:
    """Mean, deviation, least, median and most of each feature."""
    long = df.select(*(F.col(c).cast("double") for c in features)).unpivot([], list(features), "feature", "value")
    one = long.groupBy("feature").agg(*(C.rounded(f("value"), 3).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev), ("min", F.min), ("max", F.max))))
    return one.join(F.broadcast(quantiles(long, ["feature"], "value", {"median": 0.5})), "feature").withColumn("median", C.rounded("median", 3))


def spend_share(suppliers: DataFrame) -> DataFrame:
    """Each supplier's share of all positive spend in percent; the total is one row, sent to all tasks."""
    spend = suppliers.select("supplier_id", F.greatest(F.coalesce("annual_spend_usd", F.lit(0.0)), F.lit(0.0)).alias("spend"))
    total = spend.agg(F.sum("spend").alias("total"))
    return spend.crossJoin(F.broadcast(total)).select("supplier_id", (F.col("spend") / F.col("total") * 100).alias("spend_share_pct"))


def concentration(suppliers: DataFrame, by: str = "primary_category") -> DataFrame:
    """Sum of squared shares of spend within each group."""
    spend = suppliers.select(by, F.greatest(F.coalesce("annual_spend_usd", F.lit(0.0)), F.lit(0.0)).alias("spend"))
    share = spend.groupBy(by).agg(F.sum("spend").alias("total"), F.sum(F.col("spend") * F.col("spend")).alias("squares"))
    return share.select(by, F.try_divide("squares", F.col("total") * F.col("total")).alias("hhi"))


def executive_summary(risk: DataFrame, stock: DataFrame, events: DataFrame) -> DataFrame:
    """One row: numbers at risk, the three riskiest suppliers, a message. Each part is one aggregate row."""
    order = F.struct((-F.col("composite")).alias("o"), F.col("supplier_id").alias("id"))
    ranked = top(risk.filter("composite is not null"), 3, F.col("composite").desc(), "supplier_id")
    first = ranked.agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["id"].cast("string")), ",").alias("top_suppliers"))
    high = risk.agg(F.sum((F.col("composite") >= 0.5).cast("long")).alias("high_risk"))
    low = stock.agg(F.sum((F.col("days_of_supply") < 14).cast("long")).alias("stockout_risk"))
    live = events.agg(F.sum(((F.col("status") == "ACTIVE") & F.col("severity").isin("CRITICAL", "HIGH")).cast("long")).alias("active_events"))
    one = high.crossJoin(low).crossJoin(live).crossJoin(first)
    return one.withColumn("message", F.format_string("%d high-risk suppliers, %d SKUs short, %d active events", "high_risk", "stockout_risk", "active_events"))


def briefing(risk: DataFrame, stock: DataFrame) -> DataFrame:
    """One row of portfolio totals."""
    tiers = [F.sum((F.col("risk_tier") == t).cast("long")).alias(f"n_{t.lower()}") for t in ("CRITICAL", "HIGH", "MEDIUM", "LOW")]
    spend = F.greatest(F.coalesce("annual_spend_usd", F.lit(0.0)), F.lit(0.0))
    risky = F.sum(F.when(F.col("risk_tier").isin("CRITICAL", "HIGH"), spend).otherwise(0.0))
    a = risk.agg(*tiers, (risky / F.sum(spend) * 100).alias("pct_spend_at_risk"))
    short = lambda n: F.sum((F.col("days_of_supply") < n).cast("long"))
    b = stock.agg(short(7).alias("skus_under_7"), short(14).alias("skus_under_14"), F.sum(F.when(F.col("days_of_supply") < 7, F.col("avg_daily_revenue")).otherwise(0.0)).alias("revenue_at_risk"))
    return a.crossJoin(b)


def actions(risk: DataFrame, stock: DataFrame, metrics: DataFrame, var_limit: float = 1_000_000) -> DataFrame:
    """Rule-triggered actions as one table: purchase under 7 days of supply, alert at a probability over 0.7, escalate where the value at
    risk (``metrics``, one row with var_95) is over its limit, find a backup for critical suppliers. An escalation is of no one supplier."""
    po = stock.filter("days_of_supply < 7").select(F.lit("PURCHASE_ORDER").alias("action"), "supplier_id", F.col("sku_id"), F.col("days_of_supply").alias("measure"))
    alert = risk.filter("disruption_probability > 0.7").select(F.lit("ALERT").alias("action"), "supplier_id", F.lit(None).cast("bigint").alias("sku_id"), F.col("disruption_probability").alias("measure"))
    escalate = metrics.filter(F.col("var_95") > var_limit).select(F.lit("ESCALATE").alias("action"), F.lit(None).cast("bigint").alias("supplier_id"), F.lit(None).cast("bigint").alias("sku_id"), F.col("var_95").alias("measure"))
    backup = risk.filter("risk_tier = 'CRITICAL'").select(F.lit("BACKUP").alias("action"), "supplier_id", F.lit(None).cast("bigint").alias("sku_id"), F.col("composite").alias("measure"))
    return po.unionByName(alert).unionByName(escalate).unionByName(backup)


def purchase_orders(requests: DataFrame, stock: DataFrame, limit: float = 50_000) -> DataFrame:
    """Value, approval status and message of requested orders (sku_id, quantity, justification); unknown SKUs cost 0."""
    joined = requests.join(stock.select("sku_id", "supplier_id", "unit_cost_usd"), "sku_id", "left")
    value = F.coalesce(F.col("unit_cost_usd") * F.col("quantity"), F.lit(0.0))
    status = F.when(F.col("value_usd") > limit, "PENDING_APPROVAL").otherwise("AUTO_APPROVED")
    message = F.concat(F.lit("PO for SKU "), F.col("sku_id").cast("string"), F.lit(": "), F.col("justification"))
    return joined.withColumn("value_usd", value).withColumn("status", status).select("sku_id", "supplier_id", "quantity", "value_usd", "status", message.alias("message"))


#: Words that route a question, by class; the first class with a word in the question wins.
ROUTES = (
    ("risk", ("high risk", "critical", "risk supplier", "disruption")),
    ("var", ("var", "value at risk", "exposure", "loss", "financial")),
    ("anomaly", ("anomaly", "anomalies", "unusual", "alert", "detection")),
)


def route_question(text: str | Column) -> Column:
    low, out = F.lower(C.col(text)), None
    for name, words in ROUTES:
        test = F.lit(False)
        for word in words:
            test = test | low.contains(word)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("default")


def narrative(attribution: DataFrame, key: str = "supplier_id", k: int = 3) -> DataFrame:
    """Text per key from its k strongest attributions (key, feature, value), strongest first."""
    w = Window.partitionBy(key).orderBy(F.abs("value").desc(), "feature")
    first = attribution.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)
    line = F.concat(F.lit("  "), F.col("feature"), F.format_string(": %+.4f", C.printed("value", 4)), F.when(F.col("value") > 0, " (↑ risk)").otherwise(" (↓ risk)"))
    lines = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("x"))
    return lines.select(key, F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("narrative"))


def risk_filter(scored: DataFrame, tiers: list[str], least: float, n: int, score: str = "composite", key: str = "supplier_id") -> DataFrame:
    """The n riskiest rows of some tiers (an empty list: all) with at least a score."""
    rows = scored.filter(F.col("risk_tier").isin(*tiers)) if tiers else scored
    return top(rows.filter(F.col(score) >= least), n, F.col(score).desc(), key)


def alerts(risk: DataFrame, least: float = 0.7, score: str = "disruption_probability") -> DataFrame:
    """An alert for each supplier over a probability, as a row of the table of alerts."""
    summary = F.format_string("Supplier %s is %s with a disruption probability of %.4f", F.col("supplier_id").cast("string"), F.col("risk_tier"), C.rounded(score, 4))
    advice = F.when(F.col("risk_tier") == "CRITICAL", "Qualify a backup supplier").otherwise("Review open orders")
    rows = risk.filter(F.col(score) > least)
    return rows.select("supplier_id", summary.alias("risk_summary"), advice.alias("recommended_action"), F.when(F.col("risk_tier") == "CRITICAL", "CRITICAL").otherwise("HIGH").alias("urgency"), F.lit("SENT").alias("status"), F.lit("AGENT").alias("created_by"))


def anomaly_text(records: DataFrame, key: str, threshold: float) -> DataFrame:
    """One line of text per anomaly (key, score, feature, value, mean, deviation, z)."""
    low, high = (C.printed(C.rounded(F.col("mean") + k * F.col("deviation"), 4), 2) for k in (-2, 2))
    text = F.format_string("Anomaly of %s: score %.4f (threshold %.2f); %s is %.2f, expected %.2f to %.2f, z %+.3f", F.col(key).cast("string"), C.printed("score", 4), F.lit(threshold), F.col("feature"), C.printed("value", 2), low, high, C.printed("z", 3))
    return records.select(key, text.alias("text"))


def briefing_text(totals: DataFrame, metrics: DataFrame) -> DataFrame:
    """The weekly briefing as text, from one row of portfolio totals and one of tail metrics."""
    text = F.format_string(
        "Critical suppliers: %d (%.2f%% of spend at risk), high: %d. Mean loss %.0f, VaR(95%%) %.0f, CVaR(95%%) %.0f. SKUs under 7 days: %d, under 14 days: %d, revenue at risk %.2f.",
        "n_critical", C.printed("pct_spend_at_risk", 2), "n_high", *(C.printed(c, 0) for c in ("mean_loss", "var_95", "cvar_95")), "skus_under_7", "skus_under_14", C.printed("revenue_at_risk", 2),
    )
    return totals.crossJoin(metrics).select(text.alias("text"))


def what_if_text(reached: DataFrame, stock: DataFrame, metrics: DataFrame, days: int = 30) -> DataFrame:
    """seed, text: what it would mean if a supplier failed for ``days`` days.

    ``reached`` has a row per seed with the suppliers at each hop and the share of spend within reach, ``metrics`` the one row of
    tail metrics; the SKUs that run out are the seed's with fewer days of supply.
    """
    short = stock.filter(F.col("days_of_supply") < days).groupBy(F.col("supplier_id").alias("seed")).agg(F.count("*").alias("n_short"))
    rows = reached.join(short, "seed", "left").fillna({"n_short": 0}).crossJoin(F.broadcast(metrics))
    text = F.format_string(
        f"If supplier %d fails for {days} days: mean loss %.0f, VaR(95%%) %.0f, CVaR(95%%) %.0f; %d SKUs run out; %d suppliers one step away, %d two and %d three steps, with %.2f%% of spend.",
        "seed", *(C.printed(c, 0) for c in ("mean_loss", "var_95", "cvar_95")), "n_short", "n_hop1", "n_hop2", "n_hop3", C.rounded("spend_pct", 2),
    )
    return rows.select("seed", text.alias("text"))


def geo_report(country: DataFrame) -> DataFrame:
    """One row: country days, critical ones, their share."""
    hit = (F.col("geo_risk_tier") == "CRITICAL").cast("long")
    return country.agg(F.count("*").alias("total"), F.sum(hit).alias("critical"), F.avg(hit.cast("double")).alias("critical_rate"))


def label_report(features: DataFrame) -> DataFrame:
    """One row: shipments and the share with the disruption label."""
    return features.agg(F.count("*").alias("total"), F.avg(F.col("label").cast("double")).alias("label_rate"))
