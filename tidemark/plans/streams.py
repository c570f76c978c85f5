"""Streaming queries, drained over the files that are there, with SQL for their complete results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import silver
from tidemark.plans import registry, relational
from tidemark.plans.registry import register
from tidemark.plans.sqltext import with_feeds
from tidemark.sources.stored import shared_dir
from tidemark.sources.adapters import AS_OF, Feeds
from tidemark.streaming import streams

text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@register("st_tumbling", "select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def st_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return streams.drain(streams.tumbling(streams.event_stream(spark, d)), "update", ["start", "event_type"]).select(text("start"), "event_type", "n", C.rounded("total", 2).alias("total"))


@register("st_sliding", """
select strftime(start, '%Y-%m-%d %H:%M:%S') as start, count(*) as n, round(avg((value < 60)::int::double), 4) as rate
from (select value, unnest(generate_series(date_trunc('day', ts) - interval 6 days, date_trunc('day', ts), interval 1 day)) as start from events) group by 1""")  # fmt: skip
def st_sliding(spark: SparkSession, d: str) -> DataFrame:
    return streams.drain(streams.sliding(streams.event_stream(spark, d)), "update", ["start"]).select(text("start"), "n", C.rounded("rate", 4).alias("rate"))


@register("st_session", """
with g as (select *, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 30 minutes or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts) + interval 30 minutes, '%Y-%m-%d %H:%M:%S') as "end", user_id, count(*) as n from s group by user_id, k""")  # fmt: skip
def st_session(spark: SparkSession, d: str) -> DataFrame:
    """All sessions, those that are still open at the end of the events included."""
    return streams.drain(streams.sessions(streams.event_stream(spark, d))).select(text("start"), text("end"), "user_id", "n")


@register("st_latest", "select user_id, arg_max(event_id, ts) as event_id, arg_max(event_type, ts) as event_type, round(arg_max(value, ts), 4) as value, count(*) as n_events from events group by 1")
def st_latest(spark: SparkSession, d: str) -> DataFrame:
    return streams.drain(streams.latest_state(streams.event_stream(spark, d)), "update", ["user_id"]).select("user_id", "event_id", "event_type", C.rounded("value", 4).alias("value"), "n_events")


@register("st_dedup", "select distinct event_id, event_type, user_id from events")
def st_dedup(spark: SparkSession, d: str) -> DataFrame:
    return streams.drain(streams.distinct_events(streams.event_stream(spark, d)), "append").select("event_id", "event_type", "user_id")


@register("st_scored", """
select event_id, (abs((value - mean) / (dev + 1e-9::double)) > 2)::int as flag from events join (select event_type, avg(value) as mean, stddev_pop(value) as dev from events where ts < timestamp '2024-01-16' group by 1) using (event_type)""")  # fmt: skip
def st_scored(spark: SparkSession, d: str) -> DataFrame:
    past = Feeds(spark, d).table("events").filter("ts < '2024-01-16'")
    fitted = past.groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))
    return streams.drain(streams.scored(streams.event_stream(spark, d), fitted, 2.0), "append").select("event_id", "flag")


class StreamedLines(Feeds):
    """The feeds with order lines as a stream; the other tables stay as they are."""

    def table(self, name: str) -> DataFrame:
        return streams.event_stream(self.spark, self.folder, name, "l_shipdate") if name == "lineitem" else super().table(name)


@register("st_bronze", registry.sql_of("bronze_shipments"))
def st_bronze(spark: SparkSession, d: str) -> DataFrame:
    """Tracking events as they come in, typed and joined with the table of purchase orders."""
    typed = streams.bronze_stream(StreamedLines(spark, d).carrier(), Feeds(spark, d).purchase_orders(), AS_OF, "l_orderkey")
    rows = streams.drain(relational.bronze_columns(typed), "append")
    return rows


@register("st_sliding30", """
select strftime(start, '%Y-%m-%d %H:%M:%S') as start, user_id, count(*) as n, round(avg((value < 60)::int::double), 4) as rate
from (select user_id, value, unnest(generate_series(date_trunc('day', ts) - interval 29 days, date_trunc('day', ts), interval 1 day)) as start from events) group by 1, 2""")  # fmt: skip
def st_sliding30(spark: SparkSession, d: str) -> DataFrame:
    """The rate over 30 days, by key."""
    found = streams.drain(streams.sliding(streams.event_stream(spark, d), "30 days", by=["user_id"]), "update", ["start", "user_id"])
    return found.select(text("start"), "user_id", "n", C.rounded("rate", 4).alias("rate"))


@register("st_on_time", with_feeds("""
with p as (select l_suppkey, event_date, delay_days, supplier_id, dq_score from ship where dq_score >= 0.6 and supplier_id is not null)
select strftime(start, '%Y-%m-%d %H:%M:%S') as start, supplier_id, count(*) as n, round(avg((delay_days <= 0)::int::double), 4) as rate
from (select supplier_id, delay_days, unnest(generate_series(event_date::timestamp - interval 29 days, event_date::timestamp, interval 1 day)) as start from p)
where start + interval 30 days <= (select max(event_date)::timestamp - interval 1 day from p) group by 1, 2"""))  # fmt: skip
def st_on_time(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 30 days of the tracking stream, by supplier, that the watermark has passed."""
    typed = streams.bronze_stream(StreamedLines(spark, d).carrier(), Feeds(spark, d).purchase_orders(), AS_OF, "l_orderkey")
    folder = f"{shared_dir(spark)}/on-time-{uuid.uuid4().hex}"
    stream = silver.events(typed).select("supplier_id", "event_timestamp", "on_time")
    stream.writeStream.foreachBatch(streams.pane_writer(f"{folder}/panes")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = streams.pane_windows(spark, f"{folder}/panes")
    return found.select(text("start"), "supplier_id", "n", C.rounded("rate", 4).alias("rate"))


@register("st_tracked", """
with e as (select *, sum((event_type = 'purchase')::int) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as life from events),
l as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn, count(*) over (partition by user_id, coalesce(life, 0)) as n_events from e)
select user_id, event_id, event_type, n_events, case when event_type = 'purchase' then 'CLOSED' when ts + interval 7 days <= (select max(ts) from events) - interval 1 hour then 'EXPIRED' else 'OPEN' end as state from l where rn = 1""")  # fmt: skip
def st_tracked(spark: SparkSession, d: str) -> DataFrame:
    """The newest event of each user; a purchase ends what is known of one."""
    found = streams.drain(streams.tracked(streams.event_stream(spark, d)), "update", ["user_id"])
    return found.select("user_id", "event_id", "event_type", "n_events", "state")


#: Events arrive in four parts by time; one in 50 arrives a part later than it should.
_PARTS = """
a as (select *, least(3, part + (event_id % 50 = 7)::int) as arrival from (select *, least(3, floor(date_diff('hour', date_trunc('day', lo), ts) / 180.0))::int as part from events cross join (select min(ts) as lo from events))),
m as (select k, (select max(ts) from a where arrival < k) - interval 1 hour as mark from (select unnest(range(0, 4)) as k))"""


@register("st_late", f"""
with {_PARTS} select date_trunc('day', ts)::date::varchar as day, event_type, count(*) as n, round(sum(value), 2) as total, sum(coalesce((date_trunc('day', ts) + interval 1 day <= mark)::int, 0))::bigint as n_late
from a join m on arrival = k group by 1, 2""")  # fmt: skip
def st_late(spark: SparkSession, d: str) -> DataFrame:
    """Sums by day over four batches, with the rows that came after their day was closed merged in."""
    events = Feeds(spark, d).table("events")
    first = events.agg(F.date_trunc("day", F.min("ts")).alias("lo"))
    hours = F.floor((F.unix_timestamp("ts") - F.unix_timestamp("lo")) / 3600)
    part = F.least(F.lit(3), F.floor(hours / 180.0)) + (F.pmod("event_id", F.lit(50)) == 7).cast("int")
    arrivals = events.crossJoin(F.broadcast(first)).withColumn("arrival", F.least(F.lit(3), part)).drop("lo")
    folder = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    for k in range(4):
        arrivals.filter(F.col("arrival") == k).drop("arrival").write.parquet(f"{folder}/in/{k}")
        stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        run = stream.writeStream.foreachBatch(streams.late_writer(f"{folder}/out")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
        streams.merge_days(spark, f"{folder}/out", k - 1)
    days = spark.read.parquet(f"{folder}/out/days")
    return days.select(F.col("day").cast("string").alias("day"), "event_type", "n", C.rounded("total", 2).alias("total"), "n_late")


@register("st_ecod", """
with e as (select event_id, ts < timestamp '2024-01-16' as fit, value::double as value, hour(ts)::double as hour from events), lv as (unpivot e on value, hour into name feature value v),
c as (select feature, v, sum(sum(fit::int)) over (partition by feature order by v) / sum(sum(fit::int)) over (partition by feature) as f from lv group by 1, 2),
r as (select event_id, fit, sum(-ln(least(f, 1 - f) + 1e-9::double)) as raw from lv join c using (feature, v) group by 1, 2)
select event_id, round(raw, 4) as raw, (round(raw, 8) >= round(cut, 8))::int as flag from r cross join (select quantile_cont(raw, 0.95) as cut from r where fit)""")  # fmt: skip
def st_ecod(spark: SparkSession, d: str) -> DataFrame:
    """Events scored batch by batch by the tails of those before the middle of the month."""
    hourly = lambda df: df.withColumns({"value": F.col("value").cast("double"), "hour": F.hour("ts").cast("double")})
    past = hourly(Feeds(spark, d).table("events").filter("ts < '2024-01-16'"))
    folder = f"{shared_dir(spark)}/tails-{uuid.uuid4().hex}"
    write = streams.tail_writer(f"{folder}/scores", past, "event_id", ("value", "hour"))
    stream = hourly(streams.event_stream(spark, d))
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, raw double, flag int").parquet(f"{folder}/scores").select("event_id", C.rounded("raw", 4).alias("raw"), "flag")
