"""Quantiles, profiles and drift of any span of days from stored sketches, without reading the rows again."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import running_totals
from tidemark.operators.scoring import EPS

#: Size of a KLL sketch: ranks are right to about 0.35 %, and a sketch of up to as many values is exact.
K = 800


def _long(df: DataFrame, keys: list[str], day: str, values: list[str]) -> DataFrame:
    """keys, day, feature, value without nulls."""
    return df.select(*keys, F.to_date(day).alias("day"), *(F.col(v).cast("double").alias(v) for v in values)).unpivot([*keys, "day"], values, "feature", "value").filter("value is not null and not isnan(value)")


def daily_sketches(df: DataFrame, keys: list[str], day: str, values: list[str], k: int = K) -> DataFrame:
    """keys, day, feature, n, least, greatest, sketch: a row per key, day and column of ``values``; nulls don't count.

    The table is to be stored and grows by a day's rows a day; partial sketches are merged, so a hot key isn't collected.
    """
    long = _long(df, keys, day, values)
    return long.groupBy(*keys, "day", "feature").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))


def merged(sketches: DataFrame, keys: list[str], first: str, last: str, k: int = K) -> DataFrame:
    """keys, feature, n, least, greatest, sketch of the days from ``first`` to ``last``."""
    span = sketches.filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return span.groupBy(*keys, "feature").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def quantile(sketch: str | Column, q: float) -> Column:
    """The least value of which at least a share ``q`` of all is no larger."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(q))


def profile(sketches: DataFrame, keys: list[str], first: str, last: str, odds: dict[str, float]) -> DataFrame:
    """keys, feature, n, least, greatest and a column for each quantile of a span."""
    whole = merged(sketches, keys, first, last)
    return whole.select(*keys, "feature", "n", "least", "greatest", *(quantile("sketch", q).alias(name) for name, q in odds.items()))


def daily_counts(df: DataFrame, keys: list[str], day: str, values: list[str]) -> DataFrame:
    """keys, day, feature, value, n: how often each value occurs by key and day, for columns of few distinct values; nulls don't count."""
    return _long(df, keys, day, values).groupBy(*keys, "day", "feature", "value").agg(F.count("*").alias("n"))


def exact_profile(counts: DataFrame, keys: list[str], first: str, last: str, odds: dict[str, float]) -> DataFrame:
    """As :func:`profile`, exact, from a table of :func:`daily_counts`."""
    span = counts.filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    upto = running_totals(span.groupBy(*keys, "feature", "value").agg(F.sum("n").alias("n")), [*keys, "feature"], "value", ["n"])
    place = lambda q: F.ceil(F.col("n_all").cast("decimal(20,0)") * F.lit(Decimal(str(q))))
    found = [F.min(F.when(F.col("n_upto") >= place(q), F.col("value"))).alias(name) for name, q in odds.items()]
    return upto.groupBy(*keys, "feature").agg(F.max("n_all").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"), *found)


def _grid(sketch: str, steps: int) -> Column:
    """The middle of each of ``steps`` equal shares of a sketch's values, in order."""
    return F.kll_sketch_get_quantile_double(sketch, F.array(*(F.lit((i + 0.5) / steps) for i in range(steps))))


def psi(sketches: DataFrame, reference: tuple[str, str], current: tuple[str, str], bins: int = 10, steps: int = 1000) -> DataFrame:
    """feature, psi: stability index of two spans of days, over bins between the quantiles of the first.

    Bins are closed above, the first one below as well; equal edges make one. A bin's share is that of the middles of ``steps`` equal shares of a
    sketch that lie in it. Values of the second span beyond the first's extremes are in no bin. A feature with one value in the first span has no bin and no row.
    """
    grids = lambda span, name: merged(sketches, [], *span).select("feature", _grid("sketch", steps).alias(name), "least", "greatest")
    joined = grids(reference, "was").join(grids(current, "now").select("feature", "now"), "feature")
    inner = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: F.element_at("was", (i * (steps // bins)).cast("int")))
    edges = joined.withColumn("edges", F.array_sort(F.array_distinct(F.concat(F.array("least"), inner, F.array("greatest")))))
    pairs = F.arrays_zip(F.slice("edges", 1, F.size("edges") - 1).alias("low"), F.slice("edges", 2, F.size("edges") - 1).alias("high"))
    # a row per feature and bin
    rows = edges.select("feature", "was", "now", "least", F.explode(pairs).alias("bin")).select("feature", "was", "now", "least", F.col("bin.low").alias("low"), F.col("bin.high").alias("high"))
    inside = lambda x: (x <= F.col("high")) & ((x > F.col("low")) | (x == F.col("least")) & (F.col("low") == F.col("least")))
    share = lambda c: F.greatest(F.size(F.filter(c, inside)) / steps, F.lit(EPS))
    shares = rows.select("feature", share("was").alias("was"), share("now").alias("now"))
    return shares.groupBy("feature").agg(F.sum((F.col("now") - F.col("was")) * F.ln(F.col("now") / F.col("was"))).alias("psi"))
