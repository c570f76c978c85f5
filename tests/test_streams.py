"""Streams over several batches: late rows, closing state, chained windows, repeated events."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import streams

T0 = dt.datetime(2024, 1, 1)
EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"


class Arrivals:
    """A folder that grows part by part; a started stream sees each part as one batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, str(folder), schema, 0

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/in/{self.n}")
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/in")

    def run(self, df, name, write, mode="append"):
        query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{self.folder}/{name}").trigger(availableNow=True).start()
        query.awaitTermination()
        return query


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKS)


def at(hours, i, kind="view", user=1):
    return (i, T0 + dt.timedelta(hours=hours), user, kind, float(i))


PARTS = [
    [at(h, h) for h in range(0, 48)],
    [at(h, h) for h in range(48, 90)],
    [at(5, 1000), at(91, 1001), at(88, 1002)],  # one of a day long closed, one late within an open day
    [at(6, 1003, "error"), at(120, 1004), at(91, 1001)],
]


def test_late_rows_leave_windows_and_come_back_by_corrections(spark, tmp_path):
    arrivals = Arrivals(spark, tmp_path, EVENT)
    out, kept, rewritten, files = f"{tmp_path}/out", {}, [], []

    def keep(batch, number):
        for r in batch.collect():
            kept[r.start, r.event_type] = (r.n, r.total)

    for k, rows in enumerate(PARTS):
        arrivals.add(rows)
        arrivals.run(streams.tumbling(arrivals.stream()), "windows", keep, "update")
        arrivals.run(arrivals.stream(), "late", streams.late_writer(out))
        rewritten.append(streams.merge_days(spark, out, k - 1))
        files.append({d: sorted(os.listdir(f"{out}/days/{d}")) for d in os.listdir(f"{out}/days") if d.startswith("day=")})
    every = spark.createDataFrame([r for part in PARTS for r in part], EVENT)
    want = {(r.day, r.event_type): (r.n, r.total) for r in streams.day_sums(every).collect()}
    merged = {(r.day, r.event_type): (r.n, r.total) for r in spark.read.parquet(f"{out}/days").collect()}
    assert merged == want
    # the watermark drops both rows of the first day from the windows
    first = dt.date(2024, 1, 1)
    assert kept[T0, "view"][0] == want[first, "view"][0] - 1 and (T0, "error") not in kept
    assert {r.event_id for r in spark.read.parquet(f"{out}/corrections").collect()} == {1000, 1003}
    # a merge rewrites the days that its batches touch, and no others
    assert rewritten == [["2024-01-01", "2024-01-02"], ["2024-01-03", "2024-01-04"], ["2024-01-01", "2024-01-04"], ["2024-01-01", "2024-01-04", "2024-01-06"]]
    assert files[3]["day=2024-01-02"] == files[0]["day=2024-01-02"] and files[3]["day=2024-01-01"] != files[0]["day=2024-01-01"]
    # a batch that comes again changes nothing
    streams.late_writer(out)(spark.createDataFrame(PARTS[3], EVENT), 3)
    streams.merge_days(spark, out, 2)
    assert {(r.day, r.event_type): (r.n, r.total) for r in spark.read.parquet(f"{out}/days").collect()} == want


def test_closed_and_silent_keys_leave_the_state(spark, tmp_path):
    arrivals = Arrivals(spark, tmp_path, EVENT)
    latest, held = {}, []

    def keep(batch, number):
        latest.update({r.user_id: (r.event_id, r.n_events, r.state) for r in batch.collect()})

    parts = [
        [at(1, 1, user=1), at(2, 2, user=2), at(3.8, 3, user=3), at(4, 4, user=4)],
        [at(5, 5, "purchase", 1), at(6, 6, "purchase", 2), at(3.4, 7, user=3)],
        [at(7, 8, user=1), at(24 * 10, 9, user=4)],
        [at(24 * 10 + 1, 10, user=5)],
    ]
    for rows in parts:
        arrivals.add(rows)
        query = arrivals.run(streams.tracked(arrivals.stream(), late="1 hour"), "tracked", keep, "update")
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert held[1] < held[0]  # two of four were closed
    assert latest[2] == (6, 2, "CLOSED")
    assert latest[3] == (3, 2, "EXPIRED")  # its second event came out of order
    assert latest[1] == (8, 1, "EXPIRED")  # begun anew after the purchase, then silent
    assert latest[4] == (9, 2, "OPEN") and latest[5] == (10, 1, "OPEN")


def test_chained_windows_equal_rows_over_days(spark, tmp_path):
    import random

    rng = random.Random(1)
    schema = "supplier_id string, event_timestamp timestamp, on_time int"
    rows = [(rng.choice("ab"), T0 + dt.timedelta(days=rng.randint(10 * k, 10 * k + 9), hours=rng.randint(0, 23)), rng.randint(0, 1)) for k in range(4) for _ in range(60)]
    arrivals, found = Arrivals(spark, tmp_path, schema), {}
    for k in range(4):
        arrivals.add(rows[60 * k : 60 * k + 60])
        arrivals.run(streams.on_time_windows(arrivals.stream(), 7), "windows", lambda b, _: found.update({(r.supplier_id, r.start): (r.n, r.rate) for r in b.collect()}))
    end = max(r[1] for r in rows) - dt.timedelta(days=1)
    want = {}
    for supplier in "ab":
        for i in range(-7, 40):
            start = T0 + dt.timedelta(days=i)
            own = [r[2] for r in rows if r[0] == supplier and start <= r[1] < start + dt.timedelta(days=7)]
            if own and start + dt.timedelta(days=7) <= end:
                want[supplier, start] = (len(own), sum(own) / len(own))
    assert want.keys() <= found.keys()
    assert all(found[k][0] == n and abs(found[k][1] - rate) < 1e-12 for k, (n, rate) in want.items())


def test_an_event_of_an_earlier_batch_is_not_taken_again(spark, tmp_path):
    arrivals, seen = Arrivals(spark, tmp_path, EVENT), []
    for rows in ([at(1, 1), at(2, 2)], [at(1, 1), at(3, 3)], [at(2, 2), at(4, 4)]):
        arrivals.add(rows)
        arrivals.run(streams.distinct_events(arrivals.stream(), "1 day"), "distinct", lambda b, _: seen.extend(r.event_id for r in b.collect()))
    assert sorted(seen) == [1, 2, 3, 4]
