"""Demand: features, seasonal-naive quantile forecasts, and their errors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SERIES = ["sku", "region"]


def fourier(df: DataFrame, period: int = 52) -> DataFrame:
    angle = F.col("t") * (2 * math.pi / period)
    return df.withColumns({"fourier_sin": F.sin(angle), "fourier_cos": F.cos(angle), "weekday": F.pmod("t", F.lit(7))})


def supervised(df: DataFrame, lookback: int, horizon: int) -> DataFrame:
    """Per row the last ``lookback`` values and the next ``horizon``, where both are whole."""
    w = Window.partitionBy(*SERIES).orderBy("t")
    rows = df.withColumns({"x": F.collect_list("demand").over(w.rowsBetween(-lookback, -1)), "y": F.collect_list("demand").over(w.rowsBetween(0, horizon - 1))})
    return rows.filter((F.size("x") == lookback) & (F.size("y") == horizon))


def standardise(df: DataFrame) -> DataFrame:
    """Adds the scaled demand, and the mean and deviation of its series, by which :func:`unscale` goes back."""
    w = Window.partitionBy(*SERIES)
    fitted = df.withColumns({"mean": F.avg("demand").over(w), "deviation": F.stddev_pop("demand").over(w)})
    return fitted.withColumn("scaled", F.try_divide(F.col("demand") - F.col("mean"), F.col("deviation")))


def unscale(df: DataFrame, column: str = "scaled") -> DataFrame:
    """Adds ``restored``: the value before scaling; a series without spread is its mean."""
    return df.withColumn("restored", F.coalesce(F.col(column) * F.col("deviation"), F.lit(0.0)) + F.col("mean"))


def _errors(past: DataFrame, season: int) -> DataFrame:
    """Past errors of the rule that a value is that of a season earlier: series and error."""
    before = past.select(*SERIES, (F.col("t") + season).alias("t"), F.col("demand").alias("naive"))
    return past.join(before, [*SERIES, "t"]).select(*SERIES, (F.col("demand") - F.col("naive")).alias("error"))


def _naive(past: DataFrame, origin: int, horizon: int, season: int) -> DataFrame:
    """For the ``horizon`` steps after ``origin`` the newest past value of the same place in the season."""
    back = F.explode(F.sequence(F.lit(1), F.lit(-(-horizon // season)))).alias("k")
    later = past.select(*SERIES, F.col("t").alias("_t"), F.col("demand").alias("naive"), back).withColumn("t", F.col("_t") + F.col("k") * season)
    return later.filter((F.col("t") > origin) & (F.col("t") <= origin + horizon) & (F.col("_t") > origin - season)).select(*SERIES, "t", "naive")


def quantile_forecast(df: DataFrame, origin: int, horizon: int = 14, season: int = 52) -> DataFrame:
    """P10, P50 and P90 for the ``horizon`` steps after ``origin``: the newest value of the same place in the season plus quantiles of
    that rule's past errors a season ahead. A horizon may be longer than a season.

    There are as many groups as series, each as long as its history, so the quantiles of a series are taken in one buffer.
    """
    past = df.filter(F.col("t") <= origin)
    q = _errors(past, season).groupBy(*SERIES).agg(F.percentile("error", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    name = lambda i: F.greatest(F.lit(0.0), F.col("naive") + F.col("q")[i])
    return _naive(past, origin, horizon, season).join(q, SERIES).select(*SERIES, "t", name(0).alias("p10"), name(1).alias("p50"), name(2).alias("p90"))


def crps(df: DataFrame, origin: int, horizon: int = 14, season: int = 52) -> DataFrame:
    """Exact ranked probability score of each step after ``origin``, by series, of the whole distribution of past errors.

    The forecast puts equal weight on max(0, naive + e) for each past error e of the series. The mean distance of its values from
    one another is a sum over the values in order, each weighted by its rank, so no pair of errors is formed; adding and
    cutting at 0 leave that order as it is, so errors are ranked once a series.
    """
    past = df.filter(F.col("t") <= origin)
    order = Window.partitionBy(*SERIES).orderBy("error")
    ranked = _errors(past, season).withColumns({"i": F.row_number().over(order), "m": F.count("*").over(Window.partitionBy(*SERIES))})
    known = _naive(past, origin, horizon, season).join(df, [*SERIES, "t"])
    x = F.greatest(F.lit(0.0), F.col("naive") + F.col("error"))
    spread = F.sum((2 * F.col("i") - F.col("m") - 1) * x) / F.max(F.col("m") * F.col("m"))
    return known.join(ranked, SERIES).groupBy(*SERIES, "t").agg((F.avg(F.abs(x - F.col("demand"))) - spread).alias("crps"))


def pinball(forecast: DataFrame, actual: DataFrame) -> DataFrame:
    """Mean pinball loss of the three quantiles, MAPE of the median, mean width: one row."""
    joined = forecast.join(actual, [*SERIES, "t"])
    loss = lambda q, c: F.greatest((q - 1) * (F.col("demand") - F.col(c)), q * (F.col("demand") - F.col(c)))
    total = (loss(0.1, "p10") + loss(0.5, "p50") + loss(0.9, "p90")) / 3
    mape = F.abs(F.try_divide(F.col("demand") - F.col("p50"), F.nullif(F.col("demand"), F.lit(0.0))))
    return joined.agg(F.avg(total).alias("pinball"), F.avg(mape).alias("mape"), F.avg(F.col("p90") - F.col("p10")).alias("width"), F.count("*").alias("n"))


def rolling_origin(df: DataFrame, origins: list[int], horizon: int = 14) -> DataFrame:
    """By origin: mean pinball loss, exact ranked probability score, number of steps."""
    out = None
    for origin in origins:
        exact = crps(df, origin, horizon).agg(F.avg("crps").alias("crps"))
        row = pinball(quantile_forecast(df, origin, horizon), df).crossJoin(exact).select(F.lit(origin).alias("origin"), "pinball", "crps", "n")
        out = row if out is None else out.unionByName(row)
    return out


def by_horizon(df: DataFrame, origin: int, horizons: list[int]) -> DataFrame:
    """Errors over the steps up to each horizon after one origin, from one forecast of the longest."""
    whole = quantile_forecast(df, origin, max(horizons))
    out = None
    for horizon in horizons:
        row = pinball(whole.filter(F.col("t") <= origin + horizon), df).select(F.lit(horizon).alias("horizon"), "pinball", "mape", "width", "n")
        out = row if out is None else out.unionByName(row)
    return out
