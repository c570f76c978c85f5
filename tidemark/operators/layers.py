"""Layers that grow: after a change of some partitions of rows, only those partitions of their windows are computed and
written anew that the change reaches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.operators.blocks import day_number
from tidemark.sources.stored import discard, exists, rename, store
from tidemark.sources.tables import append_partitions, append_rows, write_partitions

#: Rows whose windows are shuffled at once.
SLICE_ROWS = 1 << 25


class WindowLayer:
    """Rows in ``path``/rows and windows over each key's last ``halo`` + 1 of them in ``path``/windows, by partitions of days.

    ``compute`` adds columns to rows, each from the row and the ``halo`` rows of its key before it, in the order of days. ``day``
    is a date; ``partition`` says, as a date format, which days lie in one partition (those without a day lie in ``none``).
    ``path``/days has the number of rows of each key and day, so how far a change reaches is known without reading rows.

    Every step may be repeated after a failure: changes are noted before anything is rewritten, and crossed off after
    the windows are written. Rows without a key are left out. Columns must be comparable (no maps).
    Windows are computed for some keys and written for some partitions after the others, about ``slice_rows`` rows at once, so
    the shuffles of one step are all that the disk holds beside the tables.
    """

    def __init__(self, spark: SparkSession, path: str, rows: T.StructType, key: str, day: str, compute: Callable[[DataFrame], DataFrame], halo: int, partition: str = "yyyy-MM", slice_rows: int | None = None):
        self.spark, self.path, self.key, self.day, self.compute, self.halo, self.partition = spark, path, key, day, compute, halo, partition
        self.slice_rows = slice_rows or SLICE_ROWS
        self.columns, self.rows = rows.names, T.StructType([*rows.fields, T.StructField("part", T.StringType())])
        self.kind = rows[key].dataType.simpleString()
        self.days = f"key {self.kind}, day int, n long, part string"

    def _read(self, name: str, schema: T.StructType | str, parts: list[str] | None = None) -> DataFrame:
        """A table of the layer, or some partitions of it; empty before it was written."""
        if not exists(self.spark, f"{self.path}/{name}"):
            fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
            return self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
        found = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return found if parts is None else found.filter(F.col("part").isin(parts))

    @staticmethod
    def _parts(df: DataFrame) -> list[str]:
        """Names of partitions: as many as there are months, or days."""
        return sorted(r.part for r in df.select("part").distinct().collect())

    def _rewrite(self, df: DataFrame, name: str) -> None:
        """Writes partitions, each in files of about the advisory size: small ones in one file, large ones in several tasks."""
        write_partitions(df.hint("rebalance", "part"), f"{self.path}/{name}", "part")

    def _groups(self, parts: list[str]) -> list[list[str]]:
        """Partitions of about ``slice_rows`` rows in all, or a single larger one, at a time."""
        counts = {r.part: r.n for r in self._read("days", self.days, parts).groupBy("part").agg(F.sum("n").alias("n")).collect()}
        groups, size = [[]], 0
        for part in parts:
            size += counts.get(part, 0)
            if groups[-1] and size > self.slice_rows:
                groups, size = [*groups, []], counts.get(part, 0)
            groups[-1].append(part)
        return groups

    def land(self, rows: DataFrame, stored: bool = False) -> list[str]:
        """Replaces the partitions that ``rows`` has rows of; the partitions in which this changes something.

        Old and new rows of partitions that were there are compared, repeats counted, and the keys and days of those that came or
        went are noted for :meth:`update`; a new partition is noted as a whole, without key and day. The same rows once again change
        nothing. ``stored`` says that ``rows`` are a table already, outside of the layer, and need not be written down first.
        """
        named = F.coalesce(F.date_format(self.day, self.partition), F.lit("none"))
        new = rows.filter(F.col(self.key).isNotNull()).select(*self.columns, named.alias("part"))
        new = new if stored else store(new, "landed")
        a_day = [F.col(self.key).alias("key"), day_number(self.day).alias("day"), "part"]
        landed = self._parts(new)
        held = self._parts(self._read("rows", self.rows, landed))
        parts = [p for p in landed if p not in held]
        changes = self.spark.range(1).select(F.explode(F.array(*map(F.lit, parts)) if parts else F.array().cast("array<string>")).alias("part"))
        changes = changes.select(F.lit(None).cast(self.kind).alias("key"), F.lit(None).cast("int").alias("day"), "part")
        if held:
            old = self._read("rows", self.rows, held).select(*new.columns, F.lit(-1).alias("_times"))
            both = new.filter(F.col("part").isin(held)).withColumn("_times", F.lit(1)).unionAll(old)
            differ = both.groupBy(*new.columns).agg(F.sum("_times").alias("_times")).filter("_times <> 0")
            changes = store(changes.unionAll(differ.select(*a_day).distinct()), "changes")
            parts = self._parts(changes)
        if parts:
            changes.write.parquet(f"{self.path}/changes/run={uuid.uuid4().hex}")
            changed = new.filter(F.col("part").isin(parts)) if len(parts) < len(landed) else new
            self._rewrite(changed.groupBy(*a_day).agg(F.count("*").alias("n")), "days")  # before the rows: they are what changes are told from
            self._rewrite(changed, "rows")
        return parts

    def reach(self, changes: DataFrame) -> DataFrame:
        """key, day, part, touched of the days that changes (key, day, part) reach, and of those whose rows they are computed from.

        A day is touched if it changed, or if fewer than ``halo`` rows of its key lie between it and the last changed day before
        it; a day is needed if that few lie between it and the next touched one. Only days of changed keys are ordered, and
        both ways by running totals, so a key costs as much as it has days.
        """
        marked = changes.select("key", "day", "part", F.lit(0).cast("long").alias("n"), F.lit(True).alias("hit")).distinct()
        days = self._read("days", self.days).join(changes.select("key").distinct(), "key", "left_semi")
        line = days.withColumn("hit", F.lit(False)).unionByName(marked).repartition("key").groupBy("key", "day", "part").agg(F.sum("n").alias("n"), F.max("hit").alias("hit"))
        by_key = Window.partitionBy("key")
        in_order = by_key.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # a day is in one partition
        line = line.withColumn("upto", F.sum("n").over(in_order)).withColumn("before", F.col("upto") - F.col("n"))
        hit = F.last(F.when(F.col("hit"), F.col("upto")), ignorenulls=True).over(in_order)
        line = line.withColumn("touched", F.coalesce(F.col("before") - hit < self.halo, F.lit(False)))
        back = by_key.orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, 0)
        touch = F.last(F.when(F.col("touched"), F.col("before")), ignorenulls=True).over(back)
        return line.withColumn("needed", touch - F.col("upto") < self.halo).filter("needed").select("key", "day", "part", "touched")

    def update(self, run: int = 0) -> list[str]:
        """Brings the windows up to date with all that landed; the partitions rewritten.

        Windows of touched days are computed from the rows they need and marked ``written`` = ``run``; all other windows of
        a rewritten partition are kept as they are. Where there are no windows yet, all are computed from all rows.
        """
        noted = self._read("changes", f"key {self.kind}, day int, part string, run string").join(self._read("done", "run string"), "run", "left_anti")
        if not exists(self.spark, f"{self.path}/windows"):
            runs = store(noted.select("run").distinct(), "noted-runs")
            rows = self._read("rows", self.rows)
            parts = self._parts(rows)
            if parts:
                n = self._read("days", self.days).agg(F.sum("n")).first()[0]
                slices, name = -(-n // self.slice_rows), f"windows-{uuid.uuid4().hex}"
                for i in range(slices):  # a folder of its own until all are there
                    own = rows.filter(F.pmod(F.xxhash64(self.key), F.lit(slices)) == i) if slices > 1 else rows
                    append_partitions(self.compute(own).withColumn("written", F.lit(run)).hint("rebalance", "part"), f"{self.path}/{name}", "part")
                rename(self.spark, f"{self.path}/{name}", f"{self.path}/windows")
            append_rows(runs, f"{self.path}/done")
            return parts
        noted = store(noted, "noted")
        whole = self._read("days", self.days, self._parts(noted.filter("key is null"))).select("key", "day", "part")
        reach = store(self.reach(noted.filter("key is not null").select("key", "day", "part").unionAll(whole)), "reach")
        touched = reach.filter("touched").select(F.col("key").alias("_k"), F.col("day").alias("_d"))
        parts = self._parts(reach.filter("touched"))
        if parts:
            at = (F.col(self.key) == F.col("_k")) & (day_number(self.day) == F.col("_d"))
            marked = reach.select(F.col("key").alias("_k"), F.col("day").alias("_d"), F.col("touched").alias("_touched"))
            rows = store(self._read("rows", self.rows, self._parts(reach)).join(marked, at).drop("_k", "_d"), "needed-rows")
            fresh = self.compute(rows).filter("_touched").drop("_touched").withColumn("written", F.lit(run))
            kept = self._read("windows", fresh.schema, parts).join(touched, at, "left_anti").select(*fresh.columns)
            both = store(fresh.unionByName(kept), "windows")
            for group in self._groups(parts):
                self._rewrite(both.filter(F.col("part").isin(group)), "windows")
            for table in (both, rows):
                discard(table)
        append_rows(noted.select("run").distinct(), f"{self.path}/done")
        return parts

    def windows(self) -> DataFrame:
        """The table of windows, with ``part`` and ``written``."""
        return self.spark.read.parquet(f"{self.path}/windows").withColumn("part", F.col("part").cast("string"))
