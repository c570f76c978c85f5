"""Streaming variants: the same column logic on a stream, windows over late data, latest state."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import columns as C
from tidemark.operators import scoring
from tidemark.operators.bronze import shipments
from tidemark.operators.ranks import quantiles
from tidemark.sources.stored import shared_dir, store
from tidemark.sources.tables import write_partitions

#: What stateful processors need; other aggregations run on it as well.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, folder: str, name: str = "events", time: str = "ts") -> DataFrame:
    """A Parquet table as a file stream; times get a zone, as a watermark needs."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    plain = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    stream = spark.readStream.schema(plain).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 1).parquet(folder)
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "7 days", step: str = "1 day", late: str = "1 hour", by: list[str] | None = None) -> DataFrame:
    by = by or []
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"), *by).agg(F.count("*").alias("n"), F.avg((F.col("value") < 60).cast("double")).alias("rate")).select(F.col("w.start").alias("start"), *by, "n", "rate")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def latest_state(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The newest event of each key so far."""
    newest = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id"))
    return events.groupBy(key).agg(newest.alias("s"), F.count("*").alias("n_events")).select(key, "s.event_id", "s.event_type", "s.value", "n_events")


def bronze_stream(events: DataFrame, orders: DataFrame, as_of: str, within: str | None = None) -> DataFrame:
    """Shipments as they come, joined with a table of purchase orders."""
    return shipments(events, orders, as_of, within)


def scored(events: DataFrame, fitted: DataFrame, limit: float = 3.0) -> DataFrame:
    """Flags values far from the fitted mean of their type; the fitted table has a row per type."""
    z = (F.col("value") - F.col("mean")) / (F.col("deviation") + 1e-9)
    return events.join(F.broadcast(fitted), "event_type").select("event_id", (F.abs(z) > limit).cast("int").alias("flag"))


def tail_writer(path: str, fitted: DataFrame, key: str, features: tuple[str, ...], contamination: float = 0.05) -> Callable[[DataFrame, int], None]:
    """Scores each batch by the tails of a fitted table's distributions: key, raw, flag, in a folder of the batch's number.

    A row is flagged from the raw score on that ``contamination`` of the fitted rows reach. The fitted table is stored once;
    a batch's values are looked up in its running counts (:func:`scoring.ecod_out_of_sample`).
    """
    past = store(scoring.long_form(fitted, key, *features), "fitted-rows")
    limit = store(quantiles(scoring.ecod_out_of_sample(past, past, key), [], "raw", {"cut": 1 - contamination}), "tail-limit")

    def write(batch: DataFrame, number: int) -> None:
        raw = scoring.ecod_out_of_sample(past, scoring.long_form(batch, key, *features), key)
        found = raw.crossJoin(F.broadcast(limit)).select(key, "raw", (C.rounded("raw", 8) >= C.rounded("cut", 8)).cast("int").alias("flag"))  # a limit of one row
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


# ---------------------------------------------------------------- windows over panes


def on_time_windows(shipments: DataFrame, days: int = 30, late: str = "1 day") -> DataFrame:
    """On-time rate of each supplier over windows of ``days`` days, one beginning each day: start, supplier_id, n, rate.

    Two aggregations in a chain: an event enters the pane of its day only, and a day's pane, a row per supplier, enters
    ``days`` windows. In append mode a window comes out once the watermark has passed its end.
    """
    daily = shipments.withWatermark("event_timestamp", late).groupBy(F.window("event_timestamp", "1 day").alias("d"), "supplier_id")
    panes = daily.agg(F.sum("on_time").alias("ok"), F.count("*").alias("n"))
    whole = panes.groupBy(F.window(F.window_time("d"), f"{days} days", "1 day").alias("w"), "supplier_id").agg(F.sum("ok").alias("ok"), F.sum("n").alias("n"))
    return whole.select(F.col("w.start").alias("start"), "supplier_id", "n", (F.col("ok") / F.col("n")).alias("rate"))


PANES = "supplier_id long, day date, ok long, n long, newest timestamp, batch long"


def pane_writer(path: str, late: str = "1 day") -> Callable[[DataFrame, int], None]:
    """Sums a batch of shipments by supplier and day into a folder of the batch's number: supplier_id, day, ok, n, newest.

    No state is held. The watermark of a batch is the newest time of all batches before it, less ``late``; rows of days that it has passed are
    left out, as a stream's aggregation does.
    """

    def write(batch: DataFrame, number: int) -> None:
        before = batch.sparkSession.read.schema(PANES).parquet(path) if number else batch.sparkSession.createDataFrame([], PANES)
        mark = before.filter(F.col("batch") < number).agg((F.max("newest") - F.expr(f"interval {late}")).alias("_mark"))
        on_time = batch.crossJoin(F.broadcast(mark)).filter(F.coalesce(day_end("event_timestamp") > F.col("_mark"), F.lit(True)))  # a row of one number
        panes = on_time.groupBy("supplier_id", F.to_date("event_timestamp").alias("day")).agg(F.sum("on_time").alias("ok"), F.count("*").alias("n"), F.max("event_timestamp").alias("newest"))
        panes.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def pane_windows(spark: SparkSession, path: str, days: int = 30, late: str = "1 day") -> DataFrame:
    """The windows of :func:`on_time_windows` from the panes of :func:`pane_writer`: start, supplier_id, n, rate, those that the watermark has passed.

    Panes are dealt by supplier once; a pane enters its windows where it lies, so the windows, many times the panes, are neither shuffled nor held as state.
    """
    panes = spark.read.schema(PANES).parquet(path)
    mark = panes.agg((F.max("newest") - F.expr(f"interval {late}")).alias("_mark"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # so many, as adaptive coalescing would go by the panes' size
    dealt = panes.select("supplier_id", "day", "ok", "n").crossJoin(F.broadcast(mark)).repartition(parts, "supplier_id")
    starts = F.sequence(F.date_sub("day", days - 1).cast("timestamp"), F.col("day").cast("timestamp"), F.expr("interval 1 day"))
    each = dealt.withColumn("start", F.explode(starts)).filter(F.col("start") + F.expr(f"interval {days} days") <= F.col("_mark"))
    whole = each.groupBy("supplier_id", "start").agg(F.sum("ok").alias("ok"), F.sum("n").alias("n"))
    return whole.select("start", "supplier_id", "n", (F.col("ok") / F.col("n")).alias("rate"))


# ---------------------------------------------------------------- state with an end


class Tracker(StatefulProcessor):
    """The newest event of each key until one of its ``closing`` types comes or it was silent for ``ttl_s`` seconds of event time.

    Hands on a row per key and batch; a closed or expired key leaves the state, and an event after that begins anew.
    """

    def __init__(self, closing: tuple[str, ...], ttl_s: int, key: str):
        self.closing, self.ttl_s, self.key = closing, ttl_s, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("newest", "event_id long, event_type string, ts_us long, n_events long")

    def _row(self, key, held: tuple, state: str) -> pd.DataFrame:
        event_id, kind, at, n = held
        return pd.DataFrame({self.key: [key[0]], "event_id": [event_id], "event_type": [kind], "ts": pd.to_datetime([at], unit="us"), "n_events": [n], "state": [state]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows), ignore_index=True)
        table = table.assign(ts_us=table["ts"].astype("datetime64[us]").astype("int64")).sort_values(["ts_us", "event_id"], kind="stable")
        held = self.held.get() if self.held.exists() else None
        open_, last, state = held, held, "OPEN"
        for event_id, kind, at in zip(table["event_id"], table["event_type"], table["ts_us"], strict=True):
            if open_ is not None and (at, event_id) < (open_[2], open_[0]):  # came out of order: counted, but not the newest
                last = open_ = (*open_[:3], open_[3] + 1)
                continue
            last = (int(event_id), kind, int(at), (open_[3] if open_ else 0) + 1)
            state = "CLOSED" if kind in self.closing else "OPEN"
            open_ = None if state == "CLOSED" else last
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if open_ is None:
            self.held.clear()
        else:
            self.held.update(open_)
            self.handle.registerTimer(open_[2] // 1000 + self.ttl_s * 1000)
        yield self._row(key, last, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            held = tuple(self.held.get())
            self.held.clear()
            yield self._row(key, held, "EXPIRED")

    def close(self) -> None:
        pass


def tracked(events: DataFrame, key: str = "user_id", closing: tuple[str, ...] = ("purchase",), ttl: str = "7 days", late: str = "1 hour") -> DataFrame:
    """The state of each key as of its newest event: key, event_id, event_type, ts, n_events since the last closing one, state.

    state is OPEN, CLOSED or EXPIRED (silent for ``ttl``, a number of days, behind the watermark). Only open keys are held.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, "event_id", "event_type", "ts").withWatermark("ts", late)
    schema = f"{key} {kind}, event_id long, event_type string, ts timestamp, n_events long, state string"
    return rows.groupBy(key).transformWithStateInPandas(Tracker(closing, int(ttl.split()[0]) * 86_400, key), schema, "update", "eventTime")


# ---------------------------------------------------------------- late data


def day_end(time: str = "ts") -> Column:
    return F.date_trunc("day", time) + F.expr("interval 1 day")


def late_writer(path: str, late: str = "1 hour") -> Callable[[DataFrame, int], None]:
    """Splits a batch at the watermark: sums by (day, event_type) of days that are open to ``panes``, rows of closed days to ``corrections``.

    The watermark of a batch is the newest time of all batches before it, less ``late``, and a day closes when it
    passes the day's end. All is written to a folder of the batch's number, so a batch that comes again changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks = spark.read.schema("newest timestamp, batch long").parquet(f"{path}/marks") if number else spark.createDataFrame([], "newest timestamp, batch long")
        mark = marks.filter(F.col("batch") < number).agg((F.max("newest") - F.expr(f"interval {late}")).alias("_mark"))
        dated = batch.crossJoin(F.broadcast(mark)).withColumn("_closed", F.coalesce(day_end() <= F.col("_mark"), F.lit(False)))  # a row of one number
        dated.filter("_closed").drop("_closed", "_mark").write.mode("overwrite").parquet(f"{path}/corrections/batch={number}")
        day_sums(dated.filter("not _closed")).write.mode("overwrite").parquet(f"{path}/panes/batch={number}")
        batch.agg(F.max("ts").alias("newest")).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    return write


def day_sums(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


PANE = "day date, event_type string, n long, total double, batch long"


def merge_days(spark: SparkSession, path: str, since: int = -1) -> list[str]:
    """Brings the table ``path``/days, partitioned by day, up to date with batches after ``since``; the days rewritten.

    A day is touched if one of those batches has a pane or a correction of it, and is summed anew from all batches; other days'
    files stay as they are. The days touched are a list of dates, as long as the batches are wide.
    """
    panes = spark.read.schema(PANE).parquet(f"{path}/panes").withColumn("n_late", F.lit(0).cast("long"))
    fixed = spark.read.parquet(f"{path}/corrections")
    fixed = fixed.groupBy(F.to_date("ts").alias("day"), "event_type", F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.count("*").alias("n_late"))
    both = panes.unionByName(fixed)
    touched = both.filter(F.col("batch") > since).select("day").distinct()
    days = both.join(touched, "day", "left_semi").groupBy("day", "event_type").agg(*(F.sum(c).alias(c) for c in ("n", "total", "n_late")))
    write_partitions(days, f"{path}/days", "day")
    return [str(r.day) for r in touched.orderBy("day").collect()]


def _checkpoint(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "complete", keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns its table.

    The table is written to the shared folder, batch by batch: the whole result in complete mode, what is new in append
    mode, and in update mode what changed, of which the latest row of each of ``keys`` counts; windows past the watermark
    leave the state.
    """
    spark = stream.sparkSession
    out = f"{_checkpoint(spark)}/table"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stream.writeStream.outputMode(mode).option("checkpointLocation", _checkpoint(spark)).trigger(availableNow=True).foreachBatch(writer(out, mode)).start().awaitTermination()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(out)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("_row")).select("_row.*")


def writer(path: str, mode: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch over what is there (complete mode), or into a folder of its own, so that a repeated batch adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    return write
