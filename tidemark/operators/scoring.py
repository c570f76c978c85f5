"""Scores without training, and exact measures of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import columns as C
from tidemark.operators.ranks import look_up, quantiles, running_totals, whole_quantile
from tidemark.sources.stored import store

EPS = 1e-9


def long_form(df: DataFrame, key: str, *features: str) -> DataFrame:
    """key, feature, value; nulls are 0."""
    return df.select(key, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features)).unpivot(key, list(features), "feature", "value")


def robust_scale(long: DataFrame) -> DataFrame:
    """Less the median, by the interquartile range; the fitted table has a row per feature."""
    fitted = quantiles(long, ["feature"], "value", {"_low": 0.25, "_mid": 0.5, "_high": 0.75})
    return long.join(F.broadcast(fitted), "feature").withColumn("scaled", F.try_divide(F.col("value") - F.col("_mid"), F.col("_high") - F.col("_low"))).drop("_low", "_mid", "_high")


def _cdf(long: DataFrame) -> DataFrame:
    """feature, value, cdf, n, n_all: the share of rows up to each distinct value, its rows and all of the feature."""
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    return store(running_totals(counts, ["feature"], "value", ["n"]).select("feature", "value", (F.col("n_upto") / F.col("n_all")).alias("cdf"), "n", "n_all"), "cdf")


def _tail_sums(rows: DataFrame, cdf: DataFrame, key: str) -> DataFrame:
    """key, raw: the tails of each feature's distribution at the row's value, summed."""
    tail = -F.ln(F.least(F.col("cdf"), 1 - F.col("cdf")) + EPS)
    return look_up(rows, cdf, ["feature", "value"]).groupBy(key).agg(F.sum(tail).alias("raw"))


def _spread_join(rows: DataFrame, feature: str, table: DataFrame) -> DataFrame:
    """Adds ``_f``, the share of the feature's values up to the row's; ``table`` has value, cdf, n, n_all.

    Values with a thousandth of the rows or more are looked up in a table sent to all tasks; rows that have one go through the join
    under a key of their own hash, so no value gathers them. Where there are only such values, nothing is shuffled.
    """
    hot = F.col("n") * 1000 > F.col("n_all")
    rows = rows.join(F.broadcast(table.filter(hot).select(F.col("value").alias("_v"), F.col("cdf").alias("_hot"))), F.col(feature) == F.col("_v"), "left").drop("_v")
    cold = table.filter(~hot).select(F.col("value").alias("_v"), F.lit(0).alias("_s"), F.col("cdf").alias("_cold"))
    if cold.isEmpty():
        return rows.withColumnRenamed("_hot", "_f")
    found = F.col("_hot").isNotNull()
    rows = rows.withColumns({"_k": F.when(~found, F.col(feature)), "_t": F.when(found, F.xxhash64(*rows.columns)).otherwise(0)})
    rows = rows.join(cold, (F.col("_k") == F.col("_v")) & (F.col("_t") == F.col("_s")), "left")
    return rows.withColumn("_f", F.coalesce("_hot", "_cold")).drop("_k", "_t", "_v", "_s", "_hot", "_cold")


def tail_rows(df: DataFrame, of: DataFrame, features: list[str], kept: list[str]) -> DataFrame:
    """``kept`` and _raw of each row: the tails of the features' distributions in ``of`` at the row's values. Nulls are 0.

    A row stays whole: it meets the distributions one by one, and is not cut into a row per feature.
    """
    cdf = _cdf(long_form(of, kept[0], *features))
    rows = df.select(*kept, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features)).withColumn("_raw", F.lit(0.0))
    left = list(features)
    for feature in features:
        left.remove(feature)
        met = _spread_join(rows, feature, cdf.filter(F.col("feature") == feature).drop("feature"))
        rows = met.select(*kept, *left, (F.col("_raw") - F.ln(F.least(F.col("_f"), 1 - F.col("_f")) + EPS)).alias("_raw"))
    return rows


def tail_table(df: DataFrame, key: str, *features: str) -> DataFrame:
    """key and raw, the tails of each feature's empirical distribution at the row's value, summed over the rows of a key."""
    return tail_rows(df, df, list(features), [key]).groupBy(key).agg(F.sum("_raw").alias("raw"))


def row_scores(rows: DataFrame, key: str) -> DataFrame:
    """Rows of :func:`tail_rows` with the score in [0, 1] of their key, as :func:`tail_scores` gives it, in place of _raw.

    Only the extremes of keys are found first; rows are dealt by key once, and lie by it afterwards. ``rows`` are read twice.
    """
    raw = rows.groupBy(key).agg(F.sum("_raw").alias("raw"))
    limits = store(raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")), "tail-limits")
    summed = rows.withColumn("raw", F.sum("_raw").over(Window.partitionBy(key))).drop("_raw")
    return summed.crossJoin(F.broadcast(limits)).withColumn("score", _placed()).drop("raw", "lo", "hi")


def _placed() -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("raw") - F.col("lo")) / (F.col("hi") - F.col("lo") + EPS)))


def tail_scores(df: DataFrame, key: str, *features: str, contamination: float = 0.05) -> DataFrame:
    """:func:`ecod` of columns instead of the long form."""
    return _flagged(store(tail_table(df, key, *features), "ecod"), key, contamination)


def ecod(long: DataFrame, key: str, contamination: float = 0.05) -> DataFrame:
    """key, raw, score in [0, 1] and flag: tails of each feature's empirical distribution, summed.

    The extremes and the threshold are one row, sent to all tasks. Sums are compared with it to eight places, so that rows
    of the same tails tie whatever the order of the sum.
    """
    return _flagged(store(_tail_sums(long, _cdf(long), key), "ecod"), key, contamination)  # read for the extremes, the threshold and the scores


def _flagged(raw: DataFrame, key: str, contamination: float) -> DataFrame:
    limits = raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).crossJoin(whole_quantile(raw, "raw", 1 - contamination, "cut"))
    return raw.crossJoin(F.broadcast(limits)).select(key, "raw", _placed().alias("score"), (C.rounded("raw", 8) >= C.rounded("cut", 8)).cast("int").alias("flag"))


def ecod_out_of_sample(fitted: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """Raw scores of rows by the distribution of other rows: values of both are ordered together and fitted ones counted."""
    both = fitted.select("feature", "value", F.lit(1).alias("fit")).unionByName(scored.select("feature", "value", F.lit(0).alias("fit")))
    counts = both.groupBy("feature", "value").agg(F.sum("fit").alias("fit"), F.count("*").alias("n"))
    cdf = running_totals(counts, ["feature"], "value", ["fit", "n"]).select("feature", "value", (F.col("fit_upto") / F.col("fit_all")).alias("cdf"), "n", "n_all")
    return _tail_sums(scored, cdf, key)


def z_scores(long: DataFrame, signed: bool = False, of: DataFrame | None = None) -> DataFrame:
    """Adds z to three places, by means and deviations of ``of`` (or ``long``); with ``signed``, one that is rounded to zero from below is -0.0, for texts."""
    fitted = (long if of is None else of).groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))
    return long.join(F.broadcast(fitted), "feature").withColumn("z", C.rounded((F.col("value") - F.col("mean")) / (F.col("deviation") + EPS), 3, signed)).drop("mean", "deviation")


def strongest(long: DataFrame, key: str, by: str, k: int = 5) -> DataFrame:
    """The k features of largest absolute value in each row."""
    w = Window.partitionBy(key).orderBy(F.abs(by).desc(), "feature")
    return long.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def normal_percentile(z: str) -> Column:
    """Percentile of a z-score under the normal distribution, rounded to a tenth.

    The distribution function by a series for the error function (Abramowitz and Stegun 7.1.26, error under 1.5e-7).
    """
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    erf = 1 - poly * F.exp(-x * x)
    return C.rounded(F.when(F.col(z) >= 0, 0.5 + erf / 2).otherwise(0.5 - erf / 2) * 100, 1)


def explanations(long: DataFrame, scores: DataFrame, key: str, k: int = 5, of: DataFrame | None = None) -> DataFrame:
    """One record per scored row: score, flag, its k strongest features, maps of z-scores (by means and deviations of ``of``, or ``long``) and of normal percentiles."""
    entry = F.struct((-F.abs("z")).alias("o"), "feature", "z", normal_percentile("z").alias("percentile"))
    maps = z_scores(long, of=of).groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("s"))
    pairs = lambda c: F.map_from_entries(F.transform("s", lambda x: F.struct(x["feature"], x[c])))
    top = F.transform(F.slice("s", 1, k), lambda x: x["feature"])
    return scores.join(maps, key).select(key, "score", "flag", top.alias("top_features"), pairs("z").alias("z_map"), pairs("percentile").alias("percentile_map"))


def detector_report(scored: DataFrame, label: str, score: str = "ensemble", threshold: float = 0.6) -> DataFrame:
    """One row: ROC-AUC of the score, share of anomalies, share of labelled rows, threshold, number of rows."""
    scored = store(scored.select(label, score), "scored")  # read for the area and the shares
    area = auc(scored.select(F.lit(1).alias("_g"), F.col(label).alias("y"), F.col(score).alias("p")), ["_g"]).select("auc")
    rest = scored.agg(F.avg((F.col(score) >= threshold).cast("double")).alias("anomaly_rate"), F.avg(F.col(label).cast("double")).alias("disruption_rate"), F.count("*").alias("n_samples"))
    return area.crossJoin(rest).select(F.col("auc").alias("roc_auc"), "anomaly_rate", "disruption_rate", F.lit(threshold).alias("threshold"), "n_samples")


def anomaly_kpis(scored: DataFrame, score: str = "ensemble", flag: str = "is_anomaly") -> DataFrame:
    """One row: number, mean and largest score of the anomalies."""
    return scored.filter(F.col(flag) == 1).agg(F.count("*").alias("n_anomalies"), C.rounded(F.avg(score), 3).alias("avg_score"), C.rounded(F.max(score), 3).alias("max_score"))


def top_alerts(scored: DataFrame, key: str, score: str = "ensemble", flag: str = "is_anomaly", k: int = 5) -> DataFrame:
    """The k anomalies of largest score, with their badge."""
    badge = F.when(F.col(score) > 0.8, "CRITICAL").otherwise("HIGH")
    return scored.filter(F.col(flag) == 1).orderBy(F.col(score).desc(), key).limit(k).withColumn("badge", badge)


def importances(long: DataFrame, value: str, k: int = 10) -> DataFrame:
    """The k features of largest mean absolute value over all rows."""
    return long.groupBy("feature").agg(F.avg(F.abs(value)).alias("importance")).orderBy(F.col("importance").desc(), "feature").limit(k)


def ensemble(df: DataFrame, forest: str, tails: str, threshold: float = 0.65) -> DataFrame:
    both = F.col(forest) * 0.5 + F.col(tails) * 0.5
    return df.withColumn("ensemble", both).withColumn("is_anomaly", (F.col("ensemble") >= threshold).cast("int"))


# ---------------------------------------------------------------- measures of scores


def _cumulative(scores: DataFrame, group: list[str], y: str, p: str) -> DataFrame:
    """Per distinct score: positives and rows from the highest score to it, in their group, and totals."""
    steps = scores.groupBy(*group, F.col(p).alias("p")).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    found = running_totals(steps, group, "p", ["pos", "n"], descending=True)
    return found.withColumnsRenamed({"pos_upto": "tp", "n_upto": "rows", "pos_all": "all_pos", "n_all": "all_rows"})


def auc(scores: DataFrame, group: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Exact area under the ROC curve; ties count half; null if a class is missing."""
    c = _cumulative(scores, group, y, p)
    neg = F.col("n") - F.col("pos")
    won = F.sum(neg * (F.col("tp") - F.col("pos") + F.col("pos") / 2.0))
    all_neg = F.max("all_rows") - F.max("all_pos")
    return c.groupBy(*group).agg(F.try_divide(won, (F.max("all_pos") * all_neg).cast("double")).alias("auc"))


def average_precision(scores: DataFrame, group: list[str], y: str = "y", p: str = "p") -> DataFrame:
    c = _cumulative(scores, group, y, p)
    return c.groupBy(*group).agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("rows")), F.max("all_pos").cast("double")).alias("average_precision"))


def brier(scores: DataFrame, group: list[str], y: str = "y", p: str = "p") -> DataFrame:
    return scores.groupBy(*group).agg(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"), F.count("*").alias("n"))


def class_report(scores: DataFrame, threshold: float = 0.45, y: str = "y", p: str = "p") -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    said = (F.col(p) >= threshold).cast("int")
    one = scores.select(F.col(y).alias("y"), said.alias("s")).groupBy("y", "s").agg(F.count("*").alias("n"))
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("double")
    rows = []
    for k in (0, 1):
        hit, seen, true = count((F.col("y") == k) & (F.col("s") == k)), count(F.col("s") == k), count(F.col("y") == k)
        precision, recall = F.coalesce(F.try_divide(hit, seen), F.lit(0.0)), F.coalesce(F.try_divide(hit, true), F.lit(0.0))
        rows.append(F.struct(F.lit(k).alias("label"), precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * hit, seen + true), F.lit(0.0)).alias("f1"), true.alias("support")))
    return one.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def roc_points(scores: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    c = _cumulative(scores, [], y, p)
    return c.select("p", (F.col("tp") / F.col("all_pos")).alias("tpr"), ((F.col("rows") - F.col("tp")) / (F.col("all_rows") - F.col("all_pos"))).alias("fpr"), (F.col("tp") / F.col("rows")).alias("precision"))


def calibration(scores: DataFrame, bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return scores.groupBy(at.alias("bin")).agg(F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("share"), F.count("*").alias("n"))


def precision_at(scores: DataFrame, k: int, key: str, y: str = "y", p: str = "p") -> DataFrame:
    return scores.orderBy(F.col(p).desc(), key).limit(k).agg(F.avg(F.col(y).cast("double")).alias("precision_at_k"))


def average_rank(scores: DataFrame, p: str = "p") -> DataFrame:
    """Rank of each row by falling score; ties take their mean place, cut to a whole number. Values are counted first.

    Rows without a score stand behind all others, with their mean place among them.
    """
    known = scores.filter(F.col(p).isNotNull())
    c = _cumulative(known, [], F.lit(1), p)
    place = F.floor(F.col("rows") - (F.col("n") - 1) / 2.0).cast("bigint")
    table = store(c.select(F.col("p").alias(p), place.alias("place"), "n", F.col("all_rows").alias("n_all")), "places")
    ranked = look_up(known, table, [p]).drop("n", "n_all").select(*scores.columns, "place")
    counts = scores.agg(F.count(p).alias("_some"), F.count("*").alias("_all"))  # one row
    rest = scores.filter(F.col(p).isNull()).crossJoin(F.broadcast(counts)).select(*scores.columns, F.floor(F.col("_some") + (F.col("_all") - F.col("_some") + 1) / 2).cast("bigint").alias("place"))
    return ranked.unionByName(rest)


# ---------------------------------------------------------------- drift


def psi(reference: DataFrame, current: DataFrame, bins: int = 10) -> DataFrame:
    """Population stability index of each feature (rows: feature, value).

    Breakpoints are the distinct linear quantiles of the reference, the last bin closed; values outside count in the
    denominator only. With fewer than two breakpoints it is 0.
    """
    cuts = quantiles(reference, ["feature"], "value", {f"q{i}": i / bins for i in range(bins + 1)})
    edges = store(cuts.select("feature", F.array_sort(F.array_distinct(F.array(*(f"q{i}" for i in range(bins + 1))))).alias("edges")), "edges")

    def shares(rows: DataFrame, name: str) -> DataFrame:
        # the bin is the number of edges up to the value; the table of edges has a row per feature
        at = F.size(F.filter("edges", lambda e: e <= F.col("value")))
        last = F.size("edges")
        closed = F.when(F.col("value") == F.element_at("edges", -1), last - 1).otherwise(at)
        counted = rows.join(F.broadcast(edges), "feature").withColumn("bin", closed)
        total = rows.groupBy("feature").agg(F.count("*").alias("total"))
        binned = counted.filter((F.col("bin") > 0) & (F.col("bin") < last)).groupBy("feature", "bin").agg(F.count("*").alias("n"))
        return binned.join(F.broadcast(total), "feature").select("feature", "bin", (F.col("n") / F.col("total")).alias(name))

    spine = edges.filter(F.size("edges") > 1).select("feature", F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("bin"))
    both = spine.join(shares(reference, "e"), ["feature", "bin"], "left").join(shares(current, "a"), ["feature", "bin"], "left")
    e, a = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(EPS)) for c in ("e", "a"))
    index = both.groupBy("feature").agg(F.sum((a - e) * F.ln(a / e)).alias("psi"))
    return edges.select("feature").join(index, "feature", "left").fillna({"psi": 0.0})


def kl(reference: DataFrame, current: DataFrame, bins: int = 20) -> DataFrame:
    """One row: divergence of score densities on [0, 1], and the same for shares."""
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    density = lambda rows, name: rows.filter("score between 0 and 1").groupBy(at.alias("bin")).agg(F.count("*").alias(name))
    spine = reference.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    both = spine.join(density(reference, "r"), "bin", "left").join(density(current, "c"), "bin", "left").fillna(0)
    totals = both.agg(F.sum("r").alias("all_r"), F.sum("c").alias("all_c"))
    p, q = (F.greatest(F.col(x) / F.col(f"all_{x}") * bins, F.lit(EPS)) for x in ("c", "r"))
    return both.crossJoin(F.broadcast(totals)).agg(F.sum(p * F.ln(p / q)).alias("kl")).withColumn("kl_normalised", F.col("kl") / bins)


def drift_report(index: DataFrame, divergence: DataFrame) -> DataFrame:
    """One row: index by feature, the largest, features that drifted, flags."""
    item = F.struct("feature", C.rounded("psi", 4).alias("psi"))
    rows = index.agg(F.max("psi").alias("max_psi"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("psi") > 0.25, F.col("feature")))), ",").alias("drifted"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(item)))).alias("by_feature"))
    return rows.crossJoin(divergence).withColumn("retrain", (F.col("max_psi") > 0.25) | (F.col("kl") > 0.10))


def promotions(metrics: DataFrame, slack: float = 0.01) -> DataFrame:
    """Next status of each model version (model_type, model_id, status, auc)."""
    champion = F.max(F.when(F.col("status") == "CHAMPION", F.col("auc"))).over(Window.partitionBy("model_type"))
    best = Window.partitionBy("model_type", "ok").orderBy(F.col("auc").desc(), "model_id")
    judged = metrics.withColumn("ok", (F.col("status") == "CANDIDATE") & (F.col("auc") >= F.coalesce(champion, F.lit(0.0)) - slack)).withColumn("first", F.col("ok") & (F.row_number().over(best) == 1))
    replaced = F.max("first").over(Window.partitionBy("model_type"))
    status: Column = F.when(F.col("first"), "CHAMPION").when((F.col("status") == "CHAMPION") & replaced, "RETIRED").otherwise(F.col("status"))
    return judged.select("model_type", "model_id", "status", "auc", status.alias("next_status"))


def registry_listing(versions: DataFrame, model_type: str | None = None) -> DataFrame:
    """The registry's versions (of one type) with the first twelve digits of their checksum."""
    rows = versions.filter(F.col("model_type") == model_type) if model_type else versions
    return rows.withColumn("sha256", F.substring("sha256", 1, 12)).select("model_type", "model_id", "version", "status", "auc", "brier", "training_samples", "registered_at", "sha256")
