"""Models that are trained: risk classifier, calibration, attribution, isolation forest, contagion of edges."""

from __future__ import annotations

import json
from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.columns import model_tier
from tidemark.operators.scoring import average_rank
from tidemark.sources.stored import store


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    """Features as doubles, nulls as 0, in one vector."""
    ready = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    return VectorAssembler(inputCols=features, outputCol="features").transform(ready)


def folds(df: DataFrame, key: str, label: str, k: int = 5) -> DataFrame:
    """A fold per row, stratified: rows of a class go to the folds in turn, in the order of their keys' hashes.

    A class is split into ranges of hashes before it is counted off, so that none is ordered in one task; folds of a class
    differ by at most the number of ranges.
    """
    place = F.xxhash64(key)
    turn = Window.partitionBy(label, F.pmod(place, F.lit(256))).orderBy(place, key)
    return df.withColumn("fold", F.pmod(F.row_number().over(turn) + F.pmod(place, F.lit(256)), F.lit(k)).cast("int"))


def split(df: DataFrame, key: str, label: str, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, four fifths and one, stratified by class; for a split by time see ``training.time_split``."""
    dealt = folds(df, key, label, k)
    return dealt.filter("fold > 0").drop("fold"), dealt.filter("fold = 0").drop("fold")


def boosted(df: DataFrame, label: str, depth: int = 4, rounds: int = 20, seed: int = 42):
    return GBTClassifier(labelCol=label, featuresCol="features", maxDepth=depth, maxIter=rounds, seed=seed).fit(df)


def probability(model, df: DataFrame, name: str = "p") -> DataFrame:
    return model.transform(df).withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def search(df: DataFrame, label: str, k: int = 5) -> CrossValidatorModel:
    """Grid search of the boosted trees by mean AUC over folds (column fold)."""
    trees = GBTClassifier(labelCol=label, featuresCol="features", maxIter=10, seed=42)
    grid = ParamGridBuilder().addGrid(trees.maxDepth, [2, 4]).addGrid(trees.stepSize, [0.1, 0.3]).build()
    rater = BinaryClassificationEvaluator(labelCol=label)
    return CrossValidator(estimator=trees, estimatorParamMaps=grid, evaluator=rater, numFolds=k, foldCol="fold", parallelism=2).fit(df)


#: The nine dimensions of the search: bounds of each, drawn evenly or, where so marked, evenly in the logarithm.
SPACE: dict[str, tuple] = {
    "maxDepth": ("whole", 2, 6),
    "maxIter": ("whole", 5, 20),
    "stepSize": ("log", 0.02, 0.4),
    "subsamplingRate": ("even", 0.5, 1.0),
    "featureSubsetShare": ("even", 0.4, 1.0),
    "minInstancesPerNode": ("whole", 1, 20),
    "minInfoGain": ("log", 1e-5, 1e-2),
    "maxBins": ("whole", 16, 64),
    "minWeightFractionPerNode": ("even", 0.0, 0.05),
}
#: Settings that a search tries beside those drawn: the grid of :func:`search`.
GRID = [{"maxDepth": depth, "stepSize": step, "maxIter": 10} for depth in (2, 4) for step in (0.1, 0.3)]


def draw_points(n: int, seed: int = 42) -> list[dict[str, float]]:
    """``n`` settings drawn from the whole of :data:`SPACE`."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        point = {}
        for name, (kind, low, high) in SPACE.items():
            point[name] = int(rng.integers(low, high + 1)) if kind == "whole" else float(np.exp(rng.uniform(np.log(low), np.log(high)))) if kind == "log" else float(rng.uniform(low, high))
        out.append(point)
    return out


def classifier(point: dict[str, float], label: str, seed: int = 42) -> GBTClassifier:
    known = {("featureSubsetStrategy" if k == "featureSubsetShare" else k): (f"{v:.6f}" if k == "featureSubsetShare" and v < 1 else "all" if k == "featureSubsetShare" else v) for k, v in point.items()}
    return GBTClassifier(labelCol=label, featuresCol="features", seed=seed, **known)


def halving(df: DataFrame, label: str, points: list[dict[str, float]], keep: int = 3, k: int = 5, parallel: int = 4) -> DataFrame:
    """Successive halving over settings: trial, rung, folds (learned from), auc, kept, params (JSON).

    Folds (column fold) above 0 are learned from and fold 0 judges. On the first rung every setting learns from one fold; the best
    ``keep``-th of them go on to ``keep`` times as many folds, until the last rung learns from all. Settings of a rung are fitted side by
    side, each as a distributed fit. Equal areas go by trial. Settings of a rung and their areas are all that the driver holds.
    """
    rater = BinaryClassificationEvaluator(labelCol=label)
    judge = store(df.filter("fold = 0"), "judged")
    rows, left, n_folds, rung = [], list(range(len(points))), 1, 0
    while left:
        part = store(df.filter(F.col("fold").between(1, n_folds)), "rung")

        def fit(i: int, part: DataFrame = part) -> float:
            return float(rater.evaluate(classifier(points[i], label).fit(part).transform(judge)))

        with ThreadPool(parallel) as pool:
            found = dict(zip(left, pool.map(fit, left), strict=True))
        best = sorted(left, key=lambda i: (-found[i], i))
        last = n_folds >= k - 1
        on = best[: 1 if last else max(1, len(best) // keep)]
        rows += [(i, rung, n_folds, found[i], i in on, json.dumps(points[i], sort_keys=True)) for i in left]
        if last:
            break
        left, n_folds, rung = on, min(k - 1, n_folds * keep), rung + 1
    return df.sparkSession.createDataFrame(rows, "trial int, rung int, folds int, auc double, kept boolean, params string")


def calibrated(df: DataFrame, label: str, key: str, k: int = 5) -> DataFrame:
    """key, label, raw and calibrated probability of each row by models that did not see it.

    Each fold is scored by trees fitted to the others; a logistic regression of the label on those scores calibrates them.
    """
    parts = None
    for i in range(k):
        model = boosted(df.filter(F.col("fold") != i), label, rounds=10)
        part = probability(model, df.filter(F.col("fold") == i), "raw").select(key, label, "raw")
        parts = part if parts is None else parts.unionByName(part)
    vector = VectorAssembler(inputCols=["raw"], outputCol="features").transform(parts)
    platt = LogisticRegression(labelCol=label, featuresCol="features").fit(vector)
    return probability(platt, vector, "p").drop("features")


def score_table(scores: DataFrame, key: str) -> DataFrame:
    """Tier and average rank of each probability, riskiest first."""
    return average_rank(scores).withColumn("risk_tier", model_tier("p")).orderBy(F.col("p").desc(), key)


def attribution(df: DataFrame, label: str, key: str, features: list[str], rows: DataFrame | None = None, strongest: int | None = None) -> DataFrame:
    """key, feature, value, direction: exact shares of a linear model's log-odds, coefficient times (x less its mean).

    The model and the means are of ``df``; ``rows`` (or those of ``df``) are explained. With ``strongest``, only that many features of
    each row, those of largest absolute value (equal ones by name), with their ``place``: found inside the row, so nothing is shuffled for it.
    """
    model = LogisticRegression(labelCol=label, featuresCol="features", regParam=0.01).fit(df)
    means = df.agg(*(F.avg(F.col(f).cast("double")).alias(f"_mean_{f}") for f in features))  # one row
    weigh = lambda f, w: (F.col(f).cast("double") - F.col(f"_mean_{f}")) * float(w)
    values = [F.struct(F.lit(f).alias("feature"), weigh(f, w).alias("value")) for f, w in zip(features, model.coefficients, strict=True)]
    found = (df if rows is None else rows).crossJoin(F.broadcast(means)).select(key, F.array(*values).alias("_all"))
    if strongest is None:
        found = found.select(key, F.explode("_all").alias("_one")).select(key, "_one.*")
    else:
        # nulls stand behind all values, as they do in a falling order
        ranked = F.array_sort(F.transform("_all", lambda e: F.struct((e["value"].isNull()).alias("none"), (-F.abs(e["value"])).alias("o"), e["feature"].alias("feature"), e["value"].alias("value"))))
        found = found.select(key, F.posexplode(F.slice(ranked, 1, strongest)).alias("_at", "_one")).select(key, "_one.feature", "_one.value", (F.col("_at") + 1).alias("place"))
    direction = F.when(F.col("value") > 0, "↑ risk").otherwise("↓ risk")
    return found.select(key, "feature", "value", direction.alias("direction"), *([] if strongest is None else ["place"]))


# ---------------------------------------------------------------- isolation forest


def _grow(x: np.ndarray, features: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes (feature, cut, left, right, size) of one tree; a leaf has feature -1."""
    nodes: list[tuple] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, -1, -1, len(rows)))
        if depth < limit and len(rows) > 1:
            spread = [f for f in features if x[rows, f].min() < x[rows, f].max()]
            if spread:
                f = int(rng.choice(spread))
                cut = float(rng.uniform(x[rows, f].min(), x[rows, f].max()))
                low = x[rows, f] <= cut
                nodes[at] = (f, cut, grow(rows[low], depth + 1), grow(rows[~low], depth + 1), len(rows))
        return at

    grow(np.arange(len(x)), 0)
    return nodes


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a tree of n rows."""
    n = np.maximum(n, 1).astype(float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def _flat(tree: pd.DataFrame) -> tuple:
    """feature, cut, low, high, path, depth of a tree whose leaves lead to themselves; path is that of a row that ends in the node."""
    feature, cut, low, high, size = (tree[c].to_numpy() for c in ("feature", "cut", "low", "high", "size"))
    depth, itself = np.zeros(len(tree)), np.arange(len(tree))
    for at in itself[feature >= 0]:  # a node stands before those below it
        depth[low[at]] = depth[high[at]] = depth[at] + 1
    leaf = feature < 0
    return np.where(leaf, 0, feature), cut, np.where(leaf, itself, low), np.where(leaf, itself, high), depth + _mean_path(size), int(depth.max())


def isolation_forest(df: DataFrame, key: str, features: list[str], trees: int = 200, sample: int = 256, share: float = 0.8, seed: int = 42, carried: list[str] | None = None) -> DataFrame:
    """key, columns ``carried`` (features with nulls as 0), iso_score in [0, 1]: trees are grown in parallel on samples of ``sample`` rows, then sent to all tasks.

    Rows are drawn for a tree by their hash, about twice the sample's size, and each tree keeps those of least hash.
    The forest has at most trees * 2 * sample nodes. The score is that of the paths, 2 to the power of minus the mean path
    over the expected one, by 0.5 and cut at 1.
    """
    spark = df.sparkSession
    carried = carried or []
    rows = df.select(F.col(key).alias("key"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features), *(c for c in carried if c not in features))
    n = rows.count()
    space = 1 << 40
    odds = min(1.0, 2 * sample / max(n, 1))
    # Which trees draw a row is decided before the row is repeated for them.
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64("key", t, F.lit(seed)), F.lit(space)) < int(odds * space))
    drawn = rows.withColumn("tree", F.explode(chosen)).withColumn("draw", F.xxhash64("key", "tree", F.lit(seed)))
    limit = int(np.ceil(np.log2(sample)))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("draw").head(sample)
        rng = np.random.default_rng(seed + int(group["tree"].iloc[0]))
        used = rng.choice(len(features), max(1, int(share * len(features))), replace=False)
        nodes = _grow(group[features].to_numpy(), used, limit, rng)
        out = pd.DataFrame(nodes, columns=["feature", "cut", "low", "high", "size"])
        return out.assign(tree=int(group["tree"].iloc[0]), node=range(len(out)), rows=len(group))

    schema = "feature int, cut double, low int, high int, size int, tree int, node int, rows int"
    forest = drawn.groupBy("tree").applyInPandas(grow, schema).orderBy("tree", "node").toPandas()
    shared = spark.sparkContext.broadcast([_flat(t) for _, t in forest.groupby("tree")])
    norm = _mean_path(np.array([forest["rows"].iloc[0]]))[0] if len(forest) else 1.0

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x, total, each = np.ascontiguousarray(frame[features].to_numpy(dtype=float)).ravel(), np.zeros(len(frame)), np.arange(len(frame)) * len(features)
            for feature, cut, low, high, path, deep in shared.value:
                at = np.zeros(len(frame), int)
                for _ in range(deep):
                    at = np.where(x[each + feature[at]] <= cut[at], low[at], high[at])
                total += path[at]
            s = 2 ** (-total / max(1, len(shared.value)) / max(norm, 1e-9))
            yield frame[["key", *carried]].assign(iso_score=np.clip(s / 0.5, 0, 1))

    kept = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in ["key", *carried])
    return rows.mapInPandas(score, f"{kept}iso_score double").withColumnRenamed("key", key)


def edge_contagion(nodes: DataFrame, edges: DataFrame, features: list[str]) -> DataFrame:
    """src, dst, p: chance of contagion along each edge, from the features of both ends and the flow."""
    ends = [nodes.select(F.col("id").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in features)) for end in ("src", "dst")]
    names = [f"{end}_{c}" for end in ("src", "dst") for c in features] + ["c"]
    joined = edges.join(ends[0], "src").join(ends[1], "dst").select("src", "dst", "contagion_label", *names)
    ready = assemble(store(joined, "contagion-rows"), names)  # for the fit and the scores
    return probability(LogisticRegression(labelCol="contagion_label", featuresCol="features").fit(ready), ready).select("src", "dst", "p")


def node_risk(nodes: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """id, p: the chance that a node is disrupted, refined from its and its neighbours' features."""
    ready = assemble(nodes, features)
    return probability(LogisticRegression(labelCol=label, featuresCol="features").fit(ready), ready).select("id", "p")
