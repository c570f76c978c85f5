"""Windows over keys of any size: a key with many rows is cut into blocks of days, each with the rows before it that its
windows reach, and what a whole history carries is handed from block to block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.stored import store

#: Rows of a key from which it is cut, and about as many as a block has.
BLOCK_ROWS = 100_000


def day_number(column: str) -> Column:
    """Number of a day; null days stand before all others, as nulls do in an ascending window."""
    return F.coalesce(F.unix_date(F.col(column).cast("date")), F.lit(-(1 << 31)).cast("int"))


def day_blocks(df: DataFrame, key: str, day: str, rows: int = BLOCK_ROWS, halo: int = 0) -> DataFrame:
    """For each day of a key with more than ``rows`` rows: its ``_block`` and the blocks ``_to`` which it belongs or is halo.

    Days are counted first, with partial sums, so a key is only ordered by its days. A block begins with the first day that
    has block * ``rows`` rows before it. Two blocks in a row have more than ``rows`` rows, so a halo of up to that many
    reaches back two blocks at most; it consists of whole days, more rows than asked at times, never fewer unless there are none.
    """
    if halo > rows:
        raise ValueError("a halo can't have more rows than a block")
    of_key = Window.partitionBy("_key")
    days = df.groupBy(F.col(key).alias("_key"), day_number(day).alias("_day")).agg(F.count("*").alias("n"))
    days = days.withColumns({"total": F.sum("n").over(of_key), "before": F.sum("n").over(of_key.orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")})
    days = days.filter(F.col("total") > rows).withColumn("step", F.floor(F.col("before") / rows))
    days = days.withColumn("_block", F.dense_rank().over(of_key.orderBy("step")))
    start = lambda k: F.min("before").over(of_key.orderBy("_block").rangeBetween(k, k))
    reaches = lambda k: F.when(start(k) - F.col("before") - F.col("n") < halo, F.col("_block") + k)
    return days.select("_key", "_day", "_block", F.array_compact(F.array(F.col("_block"), reaches(1), reaches(2))).alias("_to"))


class Blocks:
    """Rows of ``df`` in blocks: windows partitioned by ``by`` see the ``halo`` rows before each row, or all of its key."""

    def __init__(self, df: DataFrame, key: str, day: str, halo: int = 0, rows: int = BLOCK_ROWS):
        self.key, self.columns, self.by = key, df.columns, [key, "_block"]
        # Only keys with more rows than a block are counted by day.
        large = store(df.groupBy(F.col(key).alias("_large")).agg(F.count("*").alias("n")).filter(F.col("n") > rows).select("_large"), "large-keys")
        self.cut = not large.isEmpty()
        if not self.cut:
            self.rows = df.withColumns({"_block": F.lit(0), "_own": F.lit(True)})
            return
        found = store(day_blocks(df.join(large, F.col(key) == F.col("_large"), "left_semi"), key, day, rows, halo), "blocks")
        placed = df.withColumn("_day", day_number(day)).join(found.withColumnRenamed("_key", "_k").withColumnRenamed("_day", "_d"), (F.col(key) == F.col("_k")) & (F.col("_day") == F.col("_d")), "left")
        dealt = placed.withColumn("_at", F.explode(F.coalesce("_to", F.array(F.lit(0)))))
        dealt = dealt.withColumn("_own", F.col("_at") == F.coalesce("_block", F.lit(0))).withColumn("_block", F.col("_at"))
        self.rows = store(dealt.select(*df.columns, "_block", "_own"), "blocked-rows")

    def window(self, *order: str) -> Window:
        return Window.partitionBy(*self.by).orderBy(*order)

    def carried(self, rows: DataFrame, totals: dict[str, Column], hand_on: dict[str, Column]) -> DataFrame:
        """``rows`` (in blocks) with columns ``hand_on`` of what the other blocks of their key hand on.

        ``totals`` are aggregates of a block; ``hand_on`` are windows over a key's blocks, a row each, in which
        ``_block`` orders them. Without a cut key they are null.
        """
        return self.carried_through(rows, totals, [hand_on], list(hand_on))

    def carried_through(self, rows: DataFrame, totals: dict[str, Column], steps: list[dict[str, Column]], names: list[str]) -> DataFrame:
        """As :meth:`carried`, with columns found in steps, each from those before it; ``names`` are kept."""
        blocks = rows.filter("_own").groupBy(*self.by).agg(*(c.alias(n) for n, c in totals.items()))
        for step in steps:
            blocks = blocks.withColumns(step)
        if not self.cut:
            return rows.withColumns({n: F.lit(None).cast(blocks.schema[n].dataType) for n in names})
        return rows.join(store(blocks.dropna("all", subset=names).select(*self.by, *names), "handed-on"), self.by, "left")

    def own(self, rows: DataFrame, *added: str) -> DataFrame:
        """Each row once again, with the columns added."""
        return rows.filter("_own").select(*self.columns, *added)


def blocks_before(key: str) -> Window:
    """The blocks of a key before each one."""
    return Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def over_days(df: DataFrame, key: str, day: str, back: int, sums: dict[str, Column]) -> DataFrame:
    """``df`` with sums over the rows of the ``back`` days before a row's day and that day.

    Sums are taken by day first, and windows run over a key's days, not its rows.
    """
    names = {n: f"_sum_{n}" for n in sums}
    panes = df.groupBy(F.col(key).alias("_k"), day_number(day).alias("_d")).agg(*(c.alias(names[n]) for n, c in sums.items()))
    w = Window.partitionBy("_k").orderBy("_d").rangeBetween(-back, 0)
    panes = panes.select("_k", "_d", *(F.sum(s).over(w).alias(n) for n, s in names.items()))
    return df.join(panes, F.col(key).eqNullSafe(F.col("_k")) & (day_number(day) == F.col("_d"))).drop("_k", "_d")


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], order: list[str] | None = None, including: bool = False, after: bool = False, rows: int = BLOCK_ROWS) -> DataFrame:
    """``left`` with ``values`` of the newest row of ``right`` before each row's time, by key; null where there is none.

    A merge, not a join: rows of both sides stand in one order of key and time, and the last value seen is carried
    on, so the work is that of one sort whatever the number of rows that lie before. ``including`` lets rows of the same time
    count, ``after`` turns time round: the oldest row at that time or later (with ``including``), or later. Right rows of one time are taken in
    the order of ``order``, the last (or, turned round, the first) one wins. Large keys are cut into blocks of days.
    A row of ``right`` whose values are all null counts; rows without a key or a time have no part in the merge, those of ``left`` get nulls.
    """
    order = order or []
    carried = F.struct(*(F.col(v) for v in values))
    left_first = including == after  # of rows of the same time
    usable = lambda df, t: df.filter(F.col(key).isNotNull() & F.col(t).isNotNull())
    whole = F.struct(*(F.col(c) for c in left.columns))
    side = usable(left, left_time).select(F.col(key).alias("_key"), F.col(left_time).cast("timestamp").alias("_time"), F.lit(0 if left_first else 1).alias("_side"), whole.alias("_left"))
    other = usable(right, right_time).select(F.col(key).alias("_key"), F.col(right_time).cast("timestamp").alias("_time"), F.lit(1 if left_first else 0).alias("_side"), F.struct(*(F.col(c) for c in order), F.lit(0).alias("_")).alias("_order"), carried.alias("_value"))
    both = side.unionByName(other, allowMissingColumns=True)
    blocks = Blocks(both, "_key", "_time", rows=rows)
    row_order = ["_time", "_side", "_order"]
    if after:
        w = blocks.window(*row_order).rowsBetween(0, Window.unboundedFollowing)
        local = F.first("_value", ignorenulls=True).over(w)
        total = F.min_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*row_order)))
        ahead = Window.partitionBy("_key").orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
        handed = F.first("_total", ignorenulls=True).over(ahead)
    else:
        w = blocks.window(*row_order).rowsBetween(Window.unboundedPreceding, 0)
        local = F.last("_value", ignorenulls=True).over(w)
        total = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*row_order)))
        handed = F.last("_total", ignorenulls=True).over(blocks_before("_key"))
    merged = blocks.carried(blocks.rows, {"_total": total}, {"_handed": handed}).withColumn("_found", F.coalesce(local, "_handed"))
    merged = merged.filter("_own and _left is not null").select("_left.*", *(F.col("_found").getField(v).alias(v) for v in values))
    rest = left.filter(F.col(key).isNull() | F.col(left_time).isNull())
    return merged.unionByName(rest.select(*left.columns, *(F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values)))
