"""Country risk from five feeds, by country and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import columns as C
from tidemark.operators.blocks import as_of


def conflict_daily(feed: DataFrame) -> DataFrame:
    day = F.to_date("event_date_str", "yyyyMMdd")
    daily = feed.groupBy("country_code", day.alias("event_date")).agg(F.avg("goldstein_scale").alias("goldstein"), F.sum("num_articles").alias("articles"), F.avg("avg_tone").alias("tone"), F.count("*").alias("n_events"))
    return daily.withColumn("conflict_score", C.clamp01((10 - F.col("goldstein")) / 20))


def governance(feed: DataFrame) -> DataFrame:
    return feed.withColumn("instability", C.clamp01((2.5 - F.col("political_stability_wgi")) / 5))


def trade_monthly(feed: DataFrame) -> DataFrame:
    month = F.to_date("period", "yyyy-MM")
    monthly = feed.groupBy(F.col("reporter_country_code").alias("country_code"), month.alias("month")).agg(F.avg("trade_deficit_ratio").alias("deficit"), F.sum("tariff_dispute_flag").alias("disputes"), F.avg("import_concentration_hhi").alias("hhi"))
    return monthly.withColumn("trade_score", F.least(F.lit(1.0), F.col("disputes") * 0.1 + F.col("deficit") * 0.5))


def commodity_rows(feed: DataFrame) -> DataFrame:
    """Volatility of each price over the last 30 rows of its series."""
    w = Window.partitionBy("commodity_code").orderBy("price_date").rowsBetween(-29, 0)
    rolled = feed.withColumns({"s": F.stddev("close_price").over(w), "m": F.avg("close_price").over(w)})
    return rolled.withColumn("volatility", F.when(F.col("m") > 0, F.col("s") / F.col("m")).otherwise(0.0)).drop("s", "m")


def commodity_daily(feed: DataFrame) -> DataFrame:
    return commodity_rows(feed).groupBy("price_date").agg(F.avg("volatility").alias("volatility"))


def port_daily(feed: DataFrame) -> DataFrame:
    daily = feed.groupBy("country_code", "event_date").agg(F.avg("wait_time_hours").alias("wait_hours"))
    return daily.withColumn("port_score", F.least(F.lit(1.0), F.col("wait_hours") / 168))


def country_risk(conflict: DataFrame, ports: DataFrame, gov: DataFrame, trade: DataFrame, commodity: DataFrame, newest: bool = False) -> DataFrame:
    """Composite score and tier per country and day of conflict, or per country on its ``newest`` day, which is picked before
    anything is joined. Each side is reduced to its key before it is joined."""
    daily = conflict_daily(conflict)
    if newest:
        columns = [c for c in daily.columns if c != "country_code"]
        daily = daily.groupBy("country_code").agg(F.max_by(F.struct(*columns), "event_date").alias("_day")).select("country_code", "_day.*")
    c = daily.withColumns({"year": F.year("event_date"), "month": F.date_trunc("month", "event_date").cast("date")})
    joined = (
        c.join(port_daily(ports), ["country_code", "event_date"], "left")
        .join(governance(gov), ["country_code", "year"], "left")
        .join(trade_monthly(trade), ["country_code", "month"], "left")
        .join(commodity_daily(commodity).withColumnRenamed("price_date", "event_date"), ["event_date"], "left")
        .fillna({"instability": 0.5, "trade_score": 0.0, "volatility": 0.0, "port_score": 0.0, "conflict_score": 0.0})
    )
    score = C.clamp01(C.weighted(instability=0.30, trade_score=0.25, conflict_score=0.20, port_score=0.15, volatility=0.10))
    return joined.withColumn("geo_score", score).withColumn("geo_risk_tier", C.geo_tier("geo_score"))


def governance_as_of(days: DataFrame, gov: DataFrame) -> DataFrame:
    """country_code, event_date with the latest governance row up to that day's year, by an as-of merge."""
    years = governance(gov).select("country_code", F.make_date("year", F.lit(1), F.lit(1)).alias("from"), F.col("year").alias("as_of_year"), F.col("political_stability_wgi").alias("wgi"))
    return as_of(days.select("country_code", "event_date").distinct(), years, "country_code", "event_date", "from", ["as_of_year", "wgi"], including=True)
