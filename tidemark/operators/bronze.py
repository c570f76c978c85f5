"""First layer: typed feeds with quality flags; nothing is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C


def suppliers(raw: DataFrame, null_flag_as: int | None = None) -> DataFrame:
    """Typed supplier master with five flags and a score.

    A null spend or lead time leaves its flag, and so the score, null; ``null_flag_as`` gives the flag a value instead.
    """
    typed = raw.withColumns(
        {
            "supplier_name": F.initcap(F.trim("supplier_name")),
            "country_code": F.upper(F.trim("country_code")),
            "annual_spend_usd": C.currency("annual_spend_usd"),
            "payment_terms_days": C.whole("payment_terms_days"),
            "avg_lead_time_days": C.whole("avg_lead_time_days"),
            "sole_source_flag": C.truthy("sole_source_flag"),
            "tier": C.whole("tier"),
            "financial_score_ext": F.col("financial_score_ext").try_cast("double"),
            "erp_last_updated": F.try_to_timestamp("erp_last_updated", F.lit("yyyy-MM-dd HH:mm:ss")),
        }
    )
    flag = lambda test: test.cast("int") if null_flag_as is None else F.coalesce(test.cast("int"), F.lit(null_flag_as))
    flagged = typed.withColumns(
        {
            "dq_null_id": F.col("supplier_id").isNull().cast("int"),
            "dq_null_name": F.col("supplier_name").isNull().cast("int"),
            "dq_null_country": F.col("country_code").isNull().cast("int"),
            "dq_negative_spend": flag(F.col("annual_spend_usd") < 0),
            "dq_bad_lead_time": flag(F.col("avg_lead_time_days") <= 0),
        }
    )
    return flagged.withColumn("dq_score", F.lit(1.0) - C.weighted(dq_null_id=0.40, dq_null_name=0.20, dq_null_country=0.20, dq_negative_spend=0.10, dq_bad_lead_time=0.10))


def delay_days(expected: str, actual: str, as_of: str | None = None) -> Column:
    """Days late; an open shipment is as late as it is overdue at ``as_of`` (or now), one without dates 0."""
    now = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
    gap = lambda end: (F.unix_timestamp(end) - F.unix_timestamp(expected)) / 86400.0
    both = F.col(expected).isNotNull() & F.col(actual).isNotNull()
    return F.when(both, gap(F.col(actual))).when(F.col(expected).isNotNull(), F.greatest(F.lit(0.0), gap(now))).otherwise(0.0)


def shipments(events: DataFrame, orders: DataFrame, as_of: str | None = None, within: str | None = None) -> DataFrame:
    """Tracking events with canonical values, joined with their purchase orders; an order of several lines fans out.

    ``within`` is a column of both sides that the purchase order determines, and by which events may lie dealt already: the join goes by it
    alone, and the purchase orders are compared as two bounds, so that they are no key to shuffle by.
    """
    typed = events.withColumns(
        {
            "canonical_status": C.canonical_status("raw_status"),
            "delay_days": delay_days("expected_delivery_date", "actual_delivery_date", as_of),
            "cargo_value_usd": C.currency("cargo_value_usd"),
            "transport_mode": C.transport_mode("carrier_type"),
        }
    ).withColumns({"is_late": (F.col("delay_days") > 0).cast("int"), "is_exception": (F.col("canonical_status") == "EXCEPTION").cast("int")})
    bare = orders.withColumnRenamed(within, "_within") if within else orders
    slim = bare.select(*(["_within"] if within else []), "purchase_order_id", "supplier_id", "sku_id", "order_quantity", "unit_cost_usd", F.upper(F.trim("incoterm")).isin(*C.ORIGIN_RISK).cast("int").alias("origin_risk_incoterm"))
    if within:
        slim = slim.withColumnRenamed("purchase_order_id", "_po")
        same = (F.col(within) == F.col("_within")) & (F.col("purchase_order_id") >= F.col("_po")) & (F.col("purchase_order_id") <= F.col("_po"))
        joined = typed.join(slim, same, "left").drop("_po", "_within", within)
    else:
        joined = typed.join(slim, "purchase_order_id", "left")
    joined = joined.withColumn("order_value_usd", F.col("order_quantity") * F.coalesce("unit_cost_usd", F.lit(0.0)))
    flagged = joined.withColumns(
        {
            "dq_null_po": F.col("purchase_order_id").isNull().cast("int"),
            "dq_null_supplier": F.col("supplier_id").isNull().cast("int"),
            "dq_unknown_status": (F.col("canonical_status") == "UNKNOWN").cast("int"),
            "dq_very_early": (F.col("delay_days") < -7).cast("int"),
        }
    )
    score = F.lit(1.0)
    for name, weight in (("dq_null_po", 0.35), ("dq_null_supplier", 0.30), ("dq_unknown_status", 0.20), ("dq_very_early", 0.15)):
        score = score - F.col(name) * F.lit(weight)
    return flagged.withColumn("dq_score", score)


def null_rates(df: DataFrame, critical: tuple[str, ...], warn_above: float = 0.05) -> DataFrame:
    """One row per critical column, from one pass: null rate, warning, number of rows, mean score."""
    one = df.agg(F.count("*").alias("total"), F.avg("dq_score").alias("avg_score"), *(F.avg(F.col(c).isNull().cast("double")).alias(f"r_{c}") for c in critical))
    rates = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"r_{c}").alias("null_rate")) for c in critical)))
    return one.select(rates.alias("x"), "total", "avg_score").select("x.column_name", "x.null_rate", (F.col("x.null_rate") > warn_above).alias("warning"), "total", "avg_score")


def shipment_report(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.sum("is_late").alias("late"), F.avg(F.col("is_late").cast("double")).alias("late_rate"), F.avg("dq_score").alias("avg_score"))
