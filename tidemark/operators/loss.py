"""Losses of scenarios, their tails, and what mitigation saves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ranks import quantiles
from tidemark.sources.stored import store


def scenario_losses(scenarios: DataFrame, inventory: DataFrame, suppliers: DataFrame) -> DataFrame:
    """scenario_id, loss: revenue lost after stock runs out, and dearer substitution, over the SKUs of disrupted suppliers.

    scenarios: (scenario_id, supplier_id, second, lead_time_draw), pairs that aren't there are undisrupted; ``second`` is
    disruption after contagion (:func:`spread_disruption`). A missing draw is the supplier's mean lead time. Revenue is
    lost for as long as the draw outlasts the stock; substitution is paid for the mean lead time.
    suppliers: (supplier_id, avg_lead_time_days, substitution_cost_factor).
    """
    hit = scenarios.filter("second = 1").join(suppliers.select("supplier_id", "avg_lead_time_days", "substitution_cost_factor"), "supplier_id")
    joined = hit.join(inventory.select("supplier_id", "days_of_supply", "avg_daily_revenue"), "supplier_id")
    draw = F.coalesce("lead_time_draw", "avg_lead_time_days")
    short = F.greatest(F.lit(0.0), draw - F.coalesce("days_of_supply", F.lit(0.0)))
    each = short * F.col("avg_daily_revenue") + F.col("avg_daily_revenue") * F.col("avg_lead_time_days") * (F.col("substitution_cost_factor") - 1)
    losses = joined.groupBy("scenario_id").agg(F.sum(each).alias("loss"))
    return scenarios.select("scenario_id").distinct().join(losses, "scenario_id", "left").fillna({"loss": 0.0})


def tail_metrics(losses: DataFrame) -> DataFrame:
    """One row: value at risk and expected shortfall at 95 and 99 %, mean, population deviation."""
    cuts = quantiles(losses, [], "loss", {"var_95": 0.95, "var_99": 0.99})
    beyond = lambda v: F.avg(F.when(F.col("loss") >= F.col(v), F.col("loss")))
    return losses.crossJoin(F.broadcast(cuts)).agg(
        F.max("var_95").alias("var_95"), F.max("var_99").alias("var_99"), beyond("var_95").alias("cvar_95"), beyond("var_99").alias("cvar_99"), F.avg("loss").alias("mean_loss"), F.stddev_pop("loss").alias("std_loss"), F.count("*").alias("n_scenarios")
    )


def any_disruption(scenarios: DataFrame) -> DataFrame:
    each = scenarios.groupBy("scenario_id").agg(F.max("second").alias("hit"))
    return each.agg(F.avg(F.col("hit").cast("double")).alias("p_any"))


def tail_attribution(scenarios: DataFrame, losses: DataFrame, suppliers: DataFrame, k: int = 10) -> DataFrame:
    """How often each supplier is disrupted in scenarios at or beyond the 95 % loss; the k most frequent."""
    metrics = quantiles(losses, [], "loss", {"var_95": 0.95})
    tail = losses.crossJoin(F.broadcast(metrics)).filter("loss >= var_95").select("scenario_id")
    n = tail.agg(F.count("*").alias("n_tail")).crossJoin(suppliers.agg(F.count("*").alias("n_sup"))).crossJoin(metrics)
    hits = scenarios.join(tail, "scenario_id", "left_semi").groupBy("supplier_id").agg(F.sum("second").alias("hits"))
    out = hits.crossJoin(F.broadcast(n)).select("supplier_id", (F.col("hits") / F.col("n_tail")).alias("tail_frequency"), (F.col("hits") / F.col("n_tail") * F.col("var_95") / F.col("n_sup")).alias("marginal_var"))
    return out.orderBy(F.col("tail_frequency").desc(), "supplier_id").limit(k)


def mitigation(options: DataFrame, metrics: DataFrame) -> DataFrame:
    """Return of options (name, reduction, cost) against the 95 % shortfall, best first."""
    avoided = F.col("cvar_95") * F.col("reduction")
    joined = options.crossJoin(F.broadcast(metrics.select("cvar_95"))).withColumns({"avoided": avoided, "net": avoided - F.col("cost"), "roi_pct": F.try_divide(avoided - F.col("cost"), F.col("cost")) * 100, "payback_months": F.try_divide(F.col("cost"), avoided / 12)})
    return joined.drop("cvar_95")


def convergence(losses: DataFrame, sizes: list[int]) -> DataFrame:
    """Value at risk and shortfall of the first n scenarios, for each n of a short list."""
    n = losses.sparkSession.createDataFrame([(s,) for s in sizes], "n int")
    prefix = losses.join(F.broadcast(n), F.col("scenario_id") < F.col("n")).withColumnRenamed("n", "size")
    cut = quantiles(prefix, ["size"], "loss", {"var_95": 0.95})
    found = prefix.join(F.broadcast(cut), "size").groupBy("size").agg(F.max("var_95").alias("var_95"), F.avg(F.when(F.col("loss") >= F.col("var_95"), F.col("loss"))).alias("cvar_95"))
    return found.withColumnRenamed("size", "n")


def spread_disruption(scenarios: DataFrame, edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds ``second`` to (scenario_id, supplier_id, disrupted, ...): disrupted itself, or where the flows from disrupted
    ones add up to over the threshold. Pairs that only contagion reaches become rows; their other columns are null.

    ``scenarios`` are read three times, so they had better be stored.
    """
    over = under_pressure(scenarios, edges, threshold).withColumn("_over", F.lit(1))
    joined = scenarios.join(over, ["scenario_id", "supplier_id"], "full").fillna({"disrupted": 0})
    return joined.withColumn("second", F.greatest("disrupted", F.coalesce("_over", F.lit(0)))).drop("_over")


#: Numbers of a block of pressures that a task holds at once, and words of 64 scenarios side by side in it.
BLOCK_SIZE, WORDS = 1 << 18, 16


def under_pressure(scenarios: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """scenario_id, supplier_id where the flows from disrupted suppliers add up to over the threshold: a product of flows and scenarios.

    The scenarios of a source are bits. They go once, with all of its flows into a block of neighbouring ends, to the task that holds
    the sums of that block; neither a flow's scenarios nor the terms of a sum are rows. The driver holds the names of the scenarios.
    Suppliers that aren't whole numbers are numbered first.
    """
    if not isinstance(edges.schema["dst"].dataType, T.IntegralType):
        numbered = store(edges.select("dst").distinct().withColumn("_number", F.monotonically_increasing_id()), "numbered")
        found = under_pressure(scenarios, edges.join(numbered, "dst").select("src", F.col("_number").alias("dst"), "c"), threshold)
        return found.join(numbered, F.col("supplier_id") == F.col("_number")).select("scenario_id", F.col("dst").alias("supplier_id"))
    spark, kind = scenarios.sparkSession, scenarios.schema["scenario_id"].dataType.simpleString()
    hit = scenarios.filter("disrupted = 1 and scenario_id is not null")
    names = sorted(r.scenario_id for r in hit.select("scenario_id").distinct().collect())
    words = min(WORDS, max(1, -(-len(names) // 64)))
    wide = 64 * words
    width = BLOCK_SIZE // wide
    places = F.broadcast(spark.createDataFrame(list(enumerate(names)), f"place long, scenario_id {kind}"))
    hit = hit.groupBy("supplier_id", "scenario_id").agg(F.count("*").alias("times")).join(places, "scenario_id")
    hit = hit.withColumns({"part": F.floor(F.col("place") / wide), "at": F.pmod("place", F.lit(wide)).cast("int")})
    bit = lambda k: F.coalesce(F.bit_or(F.when(F.floor(F.col("at") / 64) == k, F.expr("shiftleft(1L, at % 64)"))), F.lit(0).cast("long"))
    bits = hit.groupBy(F.col("supplier_id").alias("src"), "part", "times").agg(F.array(*map(bit, range(words))).alias("bits"))
    flows = edges.filter("c is not null and dst is not null").groupBy("src", F.floor(F.col("dst") / width).alias("block")).agg(F.collect_list("dst").alias("ends"), F.collect_list("c").alias("flows"))
    dealt = flows.join(bits, "src").select("block", "part", "times", "bits", "ends", "flows").repartition("block", "part").sortWithinPartitions("block", "part")

    def flush(block: int, part: int, sums: np.ndarray) -> pa.RecordBatch:
        end, at = np.nonzero(np.floor(sums * 1e8 + 0.5) / 1e8 > threshold)  # rounded to eight places
        return pa.RecordBatch.from_arrays([pa.array(part * wide + at), pa.array(block * width + end)], ["place", "supplier_id"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, None
        for batch in batches:
            lists = {c: (batch.column(c).flatten().to_numpy(), batch.column(c).value_lengths().to_numpy().cumsum()) for c in ("ends", "flows")}
            seen = np.unpackbits(batch.column("bits").flatten().to_numpy().view(np.uint8).reshape(len(batch), -1), axis=1, bitorder="little")
            times, start = batch.column("times").to_numpy(), 0
            for i, spot in enumerate(zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), strict=True)):
                if spot != key:
                    if key is not None:
                        yield flush(*key, sums)
                    key, sums = spot, np.zeros((width, wide))
                stop = lists["ends"][1][i]
                at, terms = lists["ends"][0][start:stop] - spot[0] * width, np.outer(lists["flows"][0][start:stop] * times[i], seen[i])
                if np.bincount(at).max() == 1:
                    sums[at] += terms
                else:  # parallel flows
                    np.add.at(sums, at, terms)
                start = stop
        if key is not None:
            yield flush(*key, sums)

    found = dealt.mapInArrow(add, "place long, supplier_id long").join(places, "place")
    return found.select("scenario_id", F.col("supplier_id").cast(edges.schema["dst"].dataType).alias("supplier_id"))
