"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.storage import materialize
from tidemark.llm.text import WORD


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """For one row per source (source, source_size): its target.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` of all sizes by weight. A
    target stops at ``most`` times its source's size and the others share the rest by weight, until none is above: with
    the sources in order of size per weight, those up to some point are full, and the others get an equal level per
    weight. The table has a row per source, so one task is enough for its windows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int")))
    weighed = weighed.withColumn("limit", F.lit(float(most)) * F.col("source_size")).withColumn("level", F.col("limit") / F.col("weight"))
    everything = Window.partitionBy()
    below = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    step = weighed.withColumns(
        {
            "total": F.lit(float(share)) * F.sum("source_size").over(everything),
            "full": F.coalesce(F.sum("limit").over(below), F.lit(0.0)),
            "light": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)),
        }
    )
    # the level if this source and all after it are not full; among those that are not full the first has the largest and sets the level
    step = step.withColumn("common", (F.col("total") - F.col("full")) / F.col("light"))
    step = step.withColumn("height", F.max(F.when(F.col("common") <= F.col("level"), F.col("common"))).over(everything))
    target = F.least(F.col("limit"), F.coalesce(F.col("height") * F.col("weight"), F.col("limit")))
    return step.select("source", "source_size", target.alias("target"))


def stratum(size: Column) -> Column:
    """A class of sizes that agree in their number of digits and first two digits."""
    digits = size.cast("string")
    return (F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")).cast("int")


def systematic_copies(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", bucket_rows: int = 10_000) -> DataFrame:
    """One row per document: key, source, size, source_size, target, copies.

    Size is the number of words; a null text has size 0. Within a source all documents expect target / source_size
    copies (0 if it has no words). They stand in an order of size classes, so that any stretch of like documents gets its
    share, and in a class in the order of their keys' hashes; the expected copies are summed along that order from one offset per source, drawn from ``seed``, and a
    document is taken once for each whole number that its stretch crosses: none more than ``most`` rounded up. The sums
    are taken in two steps, within buckets of (source, size class, range of hashes) and over bucket totals, so a source
    with most rows is spread over many tasks. A class of a source has as many buckets as give one about ``bucket_rows`` rows,
    as long as no key repeats as often, so there are few totals, and their number doesn't change the order. Reruns agree. Ties: equal hashes are ordered by size, and rows equal in both are
    alike, so it doesn't matter which of them is first. Keys are of any type that can be ordered. Null sources are a
    source; null keys are hashed like any other.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    rows = materialize(rows, "mix-rows")  # the words are counted once
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    rows = rows.withColumns({"stratum": stratum(F.col("size")), "hash": hashed})
    cells = rows.groupBy(F.col("source").alias("c_source"), F.col("stratum").alias("c_stratum")).agg(F.ceil(F.count("*") / bucket_rows).alias("n_buckets"))
    rows = rows.join(materialize(cells, "mix-cells"), F.col("source").eqNullSafe(F.col("c_source")) & (F.col("stratum") == F.col("c_stratum")))
    rows = rows.withColumn("bucket", F.shiftright(F.col("hash") * F.col("n_buckets"), 32)).drop("c_source", "c_stratum", "n_buckets")
    spot = ["source", "stratum", "bucket"]
    inside = Window.partitionBy(*spot)
    rows = rows.withColumn("place", F.row_number().over(inside.orderBy("hash", "size", F.col("key").asc_nulls_last())))
    totals = rows.groupBy(*spot).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("stratum", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    wanted = targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    offset = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("source"), F.lit("\\null")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    starts = (
        totals.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .select(*(F.col(c).alias(f"t_{c}") for c in spot), "before")
        .join(wanted.withColumnRenamed("source", "w_source"), F.col("t_source").eqNullSafe(F.col("w_source")))
        .drop("w_source")
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumnRenamed("t_source", "source")
        .withColumn("offset", offset)
        .withColumnRenamed("source", "t_source")
    )
    joined = rows.join(starts, (F.col("source").eqNullSafe(F.col("t_source"))) & (F.col("stratum") == F.col("t_stratum")) & (F.col("bucket") == F.col("t_bucket")))
    end = F.col("before") + F.col("place")
    crossed = lambda n: F.floor(F.col("rate") * n + F.col("offset"))
    copies = (crossed(end) - crossed(end - 1)).cast("long")
    return joined.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", copies.alias("copies"))
