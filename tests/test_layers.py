"""Layers rewritten by partition: equal to windows over all rows after any change, and nothing else is touched."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.layers import WindowLayer
from tidemark.sources.tables import write_partitions

SCHEMA = "supplier_id string, event_date date, purchase_order_id string, on_time int"
D0 = dt.date(2001, 1, 1)
HALO = 6


def seen(df):
    """Count and sum over a row and the ``HALO`` rows of its supplier before it, and the orders in it."""
    w = Window.partitionBy("supplier_id").orderBy("event_date", "purchase_order_id").rowsBetween(-HALO, 0)
    return df.withColumns({"n": F.count("*").over(w), "ok": F.sum("on_time").over(w), "ids": F.array_join(F.collect_list("purchase_order_id").over(w), " ")})


def month(row):
    return row[1].strftime("%Y-%m") if row[1] else "none"


def plain(df):
    return sorted(tuple(str(v) for v in r) for r in df.select("supplier_id", "event_date", "purchase_order_id", "on_time", "n", "ok", "ids").collect())


def files(path):
    return {f.parent.name: f.name for f in Path(path, "windows").rglob("*.parquet")}


@pytest.fixture
def case(spark, tmp_path):
    rng = random.Random(5)
    rows = [("hot" if i % 2 else f"s{i % 7}", D0 + dt.timedelta(days=rng.randint(0, 330)), f"p{i:04d}", int(rng.random() < 0.7)) for i in range(400)]
    rows += [("s0", None, "n1", 1), ("s0", None, "n2", 0), ("rare", D0, "r1", 1), ("rare", D0 + dt.timedelta(days=300), "r2", 0)]
    frame = lambda some: spark.createDataFrame(some, SCHEMA).repartition(3)
    layer = WindowLayer(spark, str(tmp_path / "layer"), frame(rows).schema, "supplier_id", "event_date", seen, HALO)
    return layer, frame, rows


def test_a_change_rewrites_what_sees_it(case):
    layer, frame, rows = case
    layer.land(frame([*rows, (None, D0, "no key", 1)]))
    first = layer.update(0)
    assert first == sorted({month(r) for r in rows})
    assert plain(layer.windows()) == plain(seen(frame(rows)))
    before = files(layer.path)
    # the same rows again, and no rows, change nothing
    assert layer.land(frame(rows)) == [] and layer.update(1) == [] and layer.land(frame([])) == [] and layer.update(1) == []
    assert files(layer.path) == before
    # one more event of a supplier with few: its month, and the one that sees it months later
    rows = [*rows, ("rare", dt.date(2001, 3, 5), "r9", 1)]
    assert layer.land(frame([r for r in rows if month(r) == "2001-03"])) == ["2001-03"]
    assert layer.update(2) == ["2001-03", "2001-10"]
    assert plain(layer.windows()) == plain(seen(frame(rows)))
    after = files(layer.path)
    assert {p for p in after if after[p] != before[p]} == {"part=2001-03", "part=2001-10"}
    assert sorted(r.purchase_order_id for r in layer.windows().filter("written = 2").collect()) == ["r2", "r9"]


def test_any_change(case):
    """Rows that come, go, change or repeat, in several places at once, and landings without an update between them."""
    layer, frame, rows = case
    layer.land(frame(rows))
    layer.update(0)
    rng = random.Random(8)
    for turn in (1, 2):
        months = rng.sample(sorted({month(r) for r in rows}), 3)
        for m in months:
            inside = [r for r in rows if month(r) == m]
            gone = set(rng.sample(inside, len(inside) // 3))
            new = [r if rng.random() < 0.9 else (*r[:3], 1 - r[3]) for r in inside if r not in gone]
            new += [(r[0], r[1], f"t{turn}{r[2]}", 1) for r in rng.sample(inside, min(3, len(inside)))]
            rows = [r for r in rows if month(r) != m] + new
            layer.land(frame(new))
        layer.update(turn)
        assert plain(layer.windows()) == plain(seen(frame(rows)))


def test_a_failed_run_is_made_good(case, monkeypatch):
    layer, frame, rows = case
    layer.land(frame(rows))
    layer.update(0)
    rows = [*rows, ("hot", dt.date(2001, 5, 5), "late", 0)]
    from tidemark.operators import layers

    real, calls = layers.write_partitions, []

    def failing(df, path, *by):
        calls.append(path)
        if path.endswith(stop):
            raise RuntimeError("lost")
        real(df, path, *by)

    monkeypatch.setattr(layers, "write_partitions", failing)
    for stop in ("/days", "/rows", "/windows"):
        with pytest.raises(RuntimeError):
            layer.land(frame([r for r in rows if month(r) == "2001-05"]))
            layer.update(1)
    monkeypatch.setattr(layers, "write_partitions", real)
    layer.land(frame([r for r in rows if month(r) == "2001-05"]))
    assert "2001-05" in layer.update(2)
    assert plain(layer.windows()) == plain(seen(frame(rows)))
    assert layer.update(3) == []


def test_a_new_partition_is_noted_as_a_whole(case):
    """Notes are as many as partitions, not as rows; a month that comes later, between others, reaches those after it."""
    layer, frame, rows = case
    late = [r for r in rows if month(r) == "2001-04"]
    layer.land(frame([r for r in rows if month(r) != "2001-04"]), stored=True)
    assert layer.spark.read.parquet(f"{layer.path}/changes").count() == len({month(r) for r in rows}) - 1
    layer.update(0)
    assert layer.land(frame(late), stored=True) == ["2001-04"]
    assert layer.spark.read.parquet(f"{layer.path}/changes").count() == len({month(r) for r in rows})
    assert {"2001-04", "2001-05"} <= set(layer.update(1)) and "2001-03" not in layer.update(2)
    assert plain(layer.windows()) == plain(seen(frame(rows)))
    assert layer.update(3) == []


def test_a_key_costs_as_much_as_it_has_days(case):
    """No window looks ahead from each row, which would cost the square of a key's days."""
    layer, frame, rows = case
    layer.land(frame(rows))
    plan = layer.reach(frame(rows).selectExpr("supplier_id as key", "unix_date(event_date) as day", "'x' as part"))._jdf.queryExecution().toString()
    assert "UnboundedPreceding" in plan or "unboundedpreceding" in plan
    assert "unboundedfollowing" not in plan.lower()


def test_windows_are_computed_slice_by_slice(spark, case, tmp_path):
    """The same windows, of a few rows at once, and no shuffle files are left of what was written."""
    _, frame, rows = case
    sliced, whole = (WindowLayer(spark, str(tmp_path / f"by-{n}"), frame(rows).schema, "supplier_id", "event_date", seen, HALO, slice_rows=n) for n in (50, 10_000))
    calls = []
    sliced.compute = lambda df: calls.append(df.count()) or seen(df)
    late = [r for r in rows if r[1] and r[1].month in (3, 4, 9)]
    for layer in (sliced, whole):
        layer.land(frame([r for r in rows if r not in late[::5]]))
        layer.update(0)
        layer.land(frame(late))
        layer.update(1)
        assert plain(layer.windows()) == plain(seen(frame(rows)))
    kept = len([r for r in rows if r not in late[::5]])
    assert len(calls) == -(-kept // 50) + 1 and sum(calls[:-1]) == kept
    assert sorted(map(tuple, sliced.windows().select("purchase_order_id", "written").collect())) == sorted(map(tuple, whole.windows().select("purchase_order_id", "written").collect()))


def test_shuffles_of_written_partitions_are_freed(spark, tmp_path):
    files = lambda: sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before = files()
    write_partitions(spark.range(1000).withColumn("part", F.col("id") % 3).hint("rebalance", "part"), str(tmp_path / "t"), "part")
    assert files() <= before and spark.read.parquet(str(tmp_path / "t")).count() == 1000
