"""Running totals and exact quantiles in two steps: inside ranges of values, and over the ranges.

No group of rows is ordered in one task: values are dealt into ranges by Spark's sampling, as many as their size asks for,
and stored with the number of their range, so that every use of them finds the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.stored import store


def running_totals(counts: DataFrame, group: list[str], value: str, sums: list[str], descending: bool = False, parts: int | None = None) -> DataFrame:
    """Adds ``<s>_upto`` and ``<s>_all`` for each column of ``sums``: its total up to the row's value, and of the group.

    ``counts`` has one row per group and value, none of them null; it is planned once. There are ``parts`` ranges, or as many as the session's
    shuffles have, fewer where they would be small.
    """
    spot = [*group, value]
    ranges = counts.repartitionByRange(parts, *spot) if parts else counts.repartitionByRange(*spot)
    placed = store(ranges.withColumn("_part", F.spark_partition_id()), "ranges")
    totals = placed.groupBy(*group, "_part").agg(*(F.sum(s).alias(s) for s in sums))  # a row per range, one more for each group
    order = lambda c: F.col(c).desc() if descending else F.col(c).asc()
    before = Window.partitionBy(*group).orderBy(order("_part")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    starts = totals.select(*group, "_part", *(F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_{s}") for s in sums), *(F.sum(s).over(whole).alias(f"{s}_all") for s in sums))
    inside = Window.partitionBy(*group, "_part").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumns({f"{s}_upto": F.sum(s).over(inside) for s in sums}).join(starts, [*group, "_part"])
    return running.withColumns({f"{s}_upto": F.col(f"{s}_upto") + F.col(f"_{s}") for s in sums}).drop("_part", *(f"_{s}" for s in sums))


def quantiles(rows: DataFrame, group: list[str], value: str, odds: dict[str, float]) -> DataFrame:
    """One row per group with a column for each name in ``odds``: the exact quantile, linear between neighbours.

    Values are counted first; the neighbours of a quantile are the least values whose running count passes its place.
    Nulls don't count.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    upto = running_totals(counts, group, value, ["n"])
    wanted = []
    for name, q in odds.items():
        place = (F.col("n_all") - 1) * q
        low, high = (F.min(F.when(F.col("n_upto") > at(place), F.col(value))) for at in (F.floor, F.ceil))
        wanted += [low.alias(f"_{name}_low"), high.alias(f"_{name}_high"), F.max(place - F.floor(place)).alias(f"_{name}_rest")]
    found = upto.groupBy(*group).agg(*wanted)
    return found.select(*group, *((F.col(f"_{n}_low") + F.col(f"_{n}_rest") * (F.col(f"_{n}_high") - F.col(f"_{n}_low"))).alias(n) for n in odds))


def whole_quantile(rows: DataFrame, value: str, q: float, name: str, width: float = 0.001) -> DataFrame:
    """One row: the exact quantile of all rows, as :func:`quantiles` gives it, without an order of them.

    Rows are counted in bins of ``width``; only values of the bins that hold the quantile's neighbours are counted one by one.
    ``rows`` is read twice.
    """
    known = rows.filter(F.col(value).isNotNull()).select(F.col(value).alias("_v"), F.floor(F.col(value) / width).alias("_bin"))
    counts = running_totals(known.groupBy("_bin").agg(F.count("*").alias("n")), [], "_bin", ["n"])
    place = (F.col("_total") - 1) * q
    passes = lambda at: (F.col("n_upto") > at) & (F.col("n_upto") - F.col("n") <= at)
    bins = counts.withColumnRenamed("n_all", "_total").filter(passes(F.floor(place)) | passes(F.ceil(place)))
    bins = store(bins.select(F.col("_bin").alias("_b"), (F.col("n_upto") - F.col("n")).alias("_before"), "_total"), "quantile-bins")  # one or two
    values = known.join(F.broadcast(bins.select("_b")), F.col("_bin") == F.col("_b")).groupBy("_b", "_v").agg(F.count("*").alias("n"))
    upto = running_totals(values, ["_b"], "_v", ["n"]).join(F.broadcast(bins), "_b").withColumn("_upto", F.col("n_upto") + F.col("_before"))
    low, high = (F.min(F.when(F.col("_upto") > at(place), F.col("_v"))) for at in (F.floor, F.ceil))
    return upto.agg(low.alias("_low"), high.alias("_high"), F.max(place - F.floor(place)).alias("_rest")).select((F.col("_low") + F.col("_rest") * (F.col("_high") - F.col("_low"))).alias(name))


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], n: str = "n", share: float = 1000) -> DataFrame:
    """``rows`` with the columns of ``table`` (unique by ``keys``, of which the first is the group), hot keys apart.

    Rows whose key isn't in the table, or is null, are left out; the table is read twice, so it had better be stored.
    Keys with over a ``share``-th of their group's rows (so at most ``share`` a group) are sent to all tasks; only rows of
    other keys are shuffled. ``<n>_all`` holds the rows of the group.
    """
    hot = F.col(n) * share > F.col(f"{n}_all")
    sent = F.broadcast(table.filter(hot))
    return rows.join(sent, keys).unionByName(rows.join(sent, keys, "left_anti").join(table.filter(~hot), keys))
