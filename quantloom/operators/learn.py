"""Walk-forward learning with Spark ML: folds, weights, ensembles, scoring, persistence."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators.evaluation import auc, regression
from quantloom.operators.summaries import class_balance
from quantloom.operators.xsection import extreme_share, group_stats
from quantloom.session import reliable

# The compact model input, raw features with their ranks.
MODEL_RAW = [
    "return_1d",
    "return_3d",
    "return_5d",
    "return_1m",
    "return_3m",
    "return_6m",
    "volatility_20d",
    "volatility_60d",
    "dist_from_sma_50",
    "dist_from_sma_200",
    "dist_from_52w_high",
    "dist_from_52w_low",
    "volume_ratio_20",
    "volume_zscore",
]


# -- folds, splits and weights --------------------------------------------------------


def expanding_folds(rows: DataFrame, first_test: int, last_test: int) -> DataFrame:
    """Every row once per fold it serves: train for later test years, test for its own.
    Adds ``test_year`` and ``part``. Years come from the row, so nothing is joined."""
    y = F.year("date")
    train = rows.where(y < last_test).withColumn(
        "test_year", F.explode(F.sequence(F.greatest(y + 1, F.lit(first_test)), F.lit(last_test)))
    )
    test = rows.where(y.between(first_test, last_test)).withColumn("test_year", y)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def test_years(rows: DataFrame, min_train_years: int = 3) -> tuple[int, int]:
    """First and last test year; two scalars."""
    lo, hi = rows.agg(F.min(F.year("date")), F.max(F.year("date"))).first()
    return lo + min_train_years, hi


def date_split(rows: DataFrame, train_end: str, validation_end: str) -> DataFrame:
    d = F.col("date")
    part = F.when(d <= F.lit(train_end).cast("date"), "train").when(d <= F.lit(validation_end).cast("date"), "validation").otherwise("test")
    return rows.withColumn("part", part)


def latest_share(rows: DataFrame, share: float = 0.2, by: Sequence[str] = (), tie: Sequence[str] = ("ticker",)) -> DataFrame:
    """Mark the newest share of the rows (by date) as validation; the first
    ``int((1 − share)·n)`` rows stay training rows."""
    keys = list(by)
    base = rows.withColumn("_day", F.datediff("date", F.lit("1900-01-01").cast("date")).cast("double"))
    early = extreme_share(base, keys, "_day", 1 - share, tie, largest=False).select(*keys, "date", *tie, F.lit(0).alias("is_validation"))
    return base.drop("_day").join(early, [*keys, "date", *tie], "left").fillna(1, ["is_validation"])


def decay_weights(rows: DataFrame, rate: float = 0.02, by: Sequence[str] = ()) -> DataFrame:
    """exp(−rate · months before the newest row), scaled to a mean of 1."""
    aged = group_stats(rows, by, {"_newest": F.max("date")})
    aged = aged.withColumn("_raw", F.exp(-rate * F.datediff("_newest", "date") / 30.0))
    out = group_stats(aged, by, {"_mean": F.avg("_raw")})
    return out.withColumn("sample_weight", F.col("_raw") / F.col("_mean")).drop("_newest", "_raw", "_mean")


# -- models -----------------------------------------------------------------------------


def assembler(features: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error")


def probability(model, rows: DataFrame, name: str) -> DataFrame:
    out = model.transform(rows).withColumn(name, vector_to_array("probability")[1])
    return out.drop("rawPrediction", "probability", "prediction")


def balanced(rows: DataFrame, target: str = "target_binary", weight: str = "sample_weight") -> DataFrame:
    """Weight positives by negatives / positives, on top of the sample weight."""
    scale = class_balance(rows, target, []).select("scale_pos_weight")
    out = rows.crossJoin(F.broadcast(scale))
    w = F.col(weight) * F.when(F.col(target) == 1, F.col("scale_pos_weight")).otherwise(1.0)
    return out.withColumn("_w", w).drop("scale_pos_weight").withColumn("label", F.col(target).cast("double"))


#: Most boosting rounds, rounds trained before the first look at the validation loss, rounds without a
#: better loss that end training, and the seeds whose models are averaged.
ROUNDS, FIRST, PATIENCE, SEEDS = 300, 48, 30, (42, 43, 44)
#: Fits that run at the same time: a small fit is bound by its many short jobs, not by the cluster.
ABREAST = 8
#: Rows in a partition of a fit, and partitions that are always left. A round is a job of two stages for every level of its tree, so
#: that partitions of a few rows cost more to start than to count; two cost no more than one. The rows a round draws follow the partitions.
ROWS_A_PART, LEAST_PARTS = 250_000, 2


def side_by_side(tasks: Sequence[Callable]) -> list:
    """Results of independent fits, run in driver threads whose jobs share the cluster."""
    with ThreadPoolExecutor(max_workers=max(1, min(ABREAST, len(tasks)))) as pool:
        return [f.result() for f in [pool.submit(t) for t in tasks]]


def tree_settings(rounds: int, depth: int, seed: int) -> dict:
    return {"maxIter": rounds, "maxDepth": depth, "stepSize": 0.1, "subsamplingRate": 0.8, "seed": seed, "featuresCol": "features"}


def training_rows(train: DataFrame, features: Sequence[str], target: str | None = None) -> DataFrame:
    """Assembled, weighted rows, written once for all seeds and families and read in as few partitions as ``ROWS_A_PART`` allows.
    The newest fifth is marked ``is_validation``. Without ``target`` the label is the binary target, balanced in ``_w``."""
    marked = latest_share(decay_weights(train))
    rows = balanced(marked) if target is None else marked.withColumn("label", F.col(target)).withColumn("_w", F.col("sample_weight"))
    written = reliable(assembler(features).transform(rows).select("features", "label", "_w", (F.col("is_validation") == 1).alias("is_validation")))
    return written.coalesce(max(LEAST_PARTS, math.ceil(written.count() / ROWS_A_PART)))


def cut_after(model, rounds: int):
    """The boosted model of the first ``rounds`` rounds: its trees and their weights, as training with fewer rounds gives them."""
    whole, context = model._java_obj, SparkSession.active().sparkContext
    kind = context._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    trees, weights = context._gateway.new_array(kind, rounds), context._gateway.new_array(context._jvm.double, rounds)
    grown = whole.trees()
    for i, weight in enumerate(model.treeWeights[:rounds]):
        trees[i], weights[i] = grown[i], weight
    if isinstance(model, GBTClassificationModel):
        java = context._jvm.org.apache.spark.ml.classification.GBTClassificationModel(whole.uid(), trees, weights, whole.numFeatures(), whole.numClasses())
    else:
        java = context._jvm.org.apache.spark.ml.regression.GBTRegressionModel(whole.uid(), trees, weights, whole.numFeatures())
    out = model._copyValues(type(model)(java))
    out._set(maxIter=rounds)
    out._transfer_params_to_java()
    return out


def _kept_rounds(losses: Sequence[float], patience: int, first: int, most: int) -> tuple[int, int]:
    """(best round, rounds looked at). Looks are at ``first``, twice that and so on, up to ``most``; the first one whose best round is
    ``patience`` rounds old is the last. If the losses end before such a look, the rounds looked at are more than there are."""
    look = min(first, most)
    while look <= len(losses):
        best = min(range(look), key=losses.__getitem__) + 1
        if best + patience <= look or look >= most:
            return best, look
        look = min(2 * look, most)
    return 0, look


def best_prefix(estimator, rows: DataFrame, patience: int = PATIENCE, first: int = FIRST, most: int = ROUNDS) -> tuple:
    """(boosted model cut after the round of least validation loss, losses of all rounds looked at).

    The losses of all prefixes come from one pass over the validation rows. Looks are doubled until the best round
    is ``patience`` rounds old or ``most`` are reached. A round's draws depend on the seed and its number only, so a model's first
    trees are the model of fewer rounds. Spark cannot go on from a fitted model: training is for ``first`` rounds and, if that
    is not enough, once more for ``most``; nothing is trained again to be cut. Without validation rows all ``first`` rounds stay.
    """
    fitted, held = rows.where(~F.col("is_validation")), rows.where("is_validation")
    if held.isEmpty() or fitted.isEmpty():
        return estimator.copy({estimator.maxIter: min(first, most)}).fit(rows), []
    for rounds in (min(first, most), most):
        model = estimator.copy({estimator.maxIter: rounds}).fit(fitted)
        losses = model.evaluateEachIteration(held) if isinstance(estimator, GBTClassifier) else model.evaluateEachIteration(held, "squared")
        best, looked = _kept_rounds(losses, patience, first, most)
        if looked <= len(losses):
            break
    return (model if best == len(losses) else cut_after(model, best)), losses[:looked]


def _staged(features: Sequence[str], model) -> PipelineModel:
    return PipelineModel(stages=[assembler(features), model])


def boosted_classifiers(train: DataFrame, features: Sequence[str], seeds: Sequence[int] = SEEDS, rounds: int = ROUNDS, depth: int = 4) -> list[PipelineModel]:
    """One boosted classifier per seed, each cut at its best round on the newest 20 %."""
    rows = training_rows(train, features)
    fit = lambda s: best_prefix(GBTClassifier(labelCol="label", weightCol="_w", **tree_settings(rounds, depth, s)), rows, most=rounds)[0]
    return [_staged(features, m) for m in side_by_side([partial(fit, s) for s in seeds])]


def mean_probability(models: Sequence, rows: DataFrame, name: str = "pred_proba") -> DataFrame:
    """Average probability over models, each appended as a column and averaged in place."""
    out, cols = rows, []
    for i, m in enumerate(models):
        out = probability(m, out, f"_p{i}").drop("features", "scaled")
        cols.append(F.col(f"_p{i}"))
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return out.withColumn(name, total / len(cols)).drop(*[f"_p{i}" for i in range(len(models))])


def boosted_regressors(train: DataFrame, features: Sequence[str], target: str, seeds: Sequence[int] = SEEDS, rounds: int = ROUNDS, depth: int = 4) -> list[PipelineModel]:
    """One boosted regressor per seed, each cut at its best round on the newest 20 %."""
    rows = training_rows(train, features, target)
    fit = lambda s: best_prefix(GBTRegressor(labelCol="label", weightCol="_w", **tree_settings(rounds, depth, s)), rows, most=rounds)[0]
    return [_staged(features, m) for m in side_by_side([partial(fit, s) for s in seeds])]


def model_families(train: DataFrame, features: Sequence[str], seed: int = 42, rounds: int = ROUNDS, depth: int = 4) -> dict[str, PipelineModel]:
    """Boosted trees, random forest and a logistic model on standardised features. The
    scaler is fitted on the training rows only."""
    rows = training_rows(train, features)
    common = {"labelCol": "label", "weightCol": "_w"}
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    boosted = partial(best_prefix, GBTClassifier(**common, **tree_settings(rounds, depth, seed)), rows, most=rounds)
    forest = partial(RandomForestClassifier(featuresCol="features", numTrees=200, maxDepth=depth + 1, seed=seed, **common).fit, rows)
    logistic = partial(Pipeline(stages=[scale, LogisticRegression(featuresCol="scaled", regParam=0.01, maxIter=30, **common)]).fit, rows)
    (cut, _losses), grown, line = side_by_side([boosted, forest, logistic])
    return {"boosted": _staged(features, cut), "forest": _staged(features, grown), "logistic": PipelineModel(stages=[assembler(features), *line.stages])}


def stacked(train: DataFrame, features: Sequence[str], folds: int = 3, seed: int = 42, most: int = ROUNDS, depth: int = 3):
    """Base learners scored out of fold (hash folds), then a logistic blend. Returns the
    blend and the base learners refitted on everything."""
    rows = reliable(train.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), "ticker", "date"), F.lit(folds)).cast("int")))
    parts = [rows.where(F.col("_fold") != k) for k in range(folds)]
    *bases, whole = side_by_side([partial(_pair, part, features, seed, most, depth) for part in [*parts, rows]])
    held = None
    for k, base in enumerate(bases):
        part = _base_scores(base, rows.where(F.col("_fold") == k))
        held = part if held is None else held.unionByName(part)
    meta_rows = reliable(balanced(decay_weights(held)))
    meta = Pipeline(stages=[assembler(["base_a", "base_b"]), LogisticRegression(labelCol="label", weightCol="_w", maxIter=30)]).fit(meta_rows)
    return meta, whole


def _pair(rows: DataFrame, features: Sequence[str], seed: int, rounds: int, depth: int) -> tuple[PipelineModel, PipelineModel]:
    ready = training_rows(rows, features)
    a, _losses = best_prefix(GBTClassifier(labelCol="label", weightCol="_w", **tree_settings(rounds, depth, seed)), ready, most=rounds)
    b = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="_w", numTrees=100, maxDepth=depth + 1, seed=seed).fit(ready)
    return _staged(features, a), _staged(features, b)


def _base_scores(pair: tuple, rows: DataFrame) -> DataFrame:
    out = probability(pair[0], rows, "base_a").drop("features")
    return probability(pair[1], out, "base_b").drop("features")


def stacked_probability(meta: PipelineModel, pair: tuple, rows: DataFrame, name: str = "pred_proba") -> DataFrame:
    return probability(meta, _base_scores(pair, rows), name).drop("features")


#: Ranges of the boosted trees' parameters: whole numbers, log-uniform and uniform draws.
RANGES = {"maxDepth": ("whole", 2, 6), "stepSize": ("log", 0.02, 0.3), "subsamplingRate": ("uniform", 0.6, 1.0), "minInstancesPerNode": ("whole", 1, 20), "minInfoGain": ("log", 1e-5, 1e-2)}


def draw_parameters(ranges: Mapping[str, tuple], n: int, seed: int = 42) -> list[dict]:
    """``n`` different seeded draws; a range is (kind, low, high) or ("choice", values)."""
    rng, out = random.Random(seed), []
    kinds = {"whole": rng.randint, "uniform": rng.uniform, "log": lambda a, b: math.exp(rng.uniform(math.log(a), math.log(b)))}
    for _ in range(50 * n):
        drawn = {name: rng.choice(given[1]) if given[0] == "choice" else kinds[given[0]](*given[1:]) for name, given in ranges.items()}
        drawn = {name: float(f"{v:.6g}") if isinstance(v, float) else v for name, v in drawn.items()}
        if drawn not in out:
            out.append(drawn)
        if len(out) == n:
            break
    return out


def search(rows: DataFrame, features: Sequence[str], ranges: Mapping[str, tuple], years: Sequence[int], metric: str = "auc", n: int = 8, rounds: Sequence[int] = (8, 16, 32), seed: int = 42, target: str = "target_regression") -> DataFrame:
    """Random search with successive halving on time-ordered splits (train before the year, validate in it).

    All draws are trained for ``rounds[0]`` boosting rounds, the better half of them for ``rounds[1]``, and so on. ``metric`` is
    ``auc`` of the binary target (larger is better) or ``rmse`` of ``target`` (smaller). Returns one row per draw and step: params, step, rounds,
    mean_score over the splits, n_splits and place in its step; the winner is place 1 of the last step.
    """
    if metric not in ("auc", "rmse"):
        raise ValueError(f"unknown metric: {metric}")
    classify = metric == "auc"
    ready = {y: training_rows(rows.where(F.year("date") < y), features, None if classify else target) for y in years}
    valid = {y: reliable(assembler(features).transform(rows.where(F.year("date") == y)).select("features", "target_binary", target)) for y in years}
    kind = GBTClassifier if classify else GBTRegressor

    def scored(chosen: dict, year: int, budget: int) -> DataFrame:
        model = kind(labelCol="label", weightCol="_w", featuresCol="features", maxIter=budget, seed=seed, **chosen).fit(ready[year])
        out = probability(model, valid[year], "score") if classify else model.transform(valid[year]).withColumnRenamed("prediction", "score")
        return out.select(F.lit(json.dumps(chosen, sort_keys=True)).alias("params"), F.lit(year).alias("year"), "score", "target_binary", F.col(target).alias("actual"))

    alive, spark, out = draw_parameters(ranges, n, seed), rows.sparkSession, []
    for step, budget in enumerate(rounds, 1):
        parts = side_by_side([partial(scored, chosen, year, budget) for chosen in alive for year in years])
        every = reliable(reduce(DataFrame.unionByName, parts))
        quality = auc(every, ["params", "year"]) if classify else regression(every, ["params", "year"], "score", "actual")
        means = {r[0]: (r[1], r[2]) for r in quality.groupBy("params").agg(F.avg(metric), F.count(metric)).collect()}  # one row per draw
        order = sorted(alive, key=lambda c: ((-1 if classify else 1) * (means[json.dumps(c, sort_keys=True)][0] or 0.0), json.dumps(c, sort_keys=True)))
        out += [(name := json.dumps(c, sort_keys=True), step, budget, *means[name], place) for place, c in enumerate(order, 1)]
        alive = order[: max(1, len(order) // 2)]
    return spark.createDataFrame(out, "params string, step int, rounds int, mean_score double, n_splits long, place int")


def standardised(train: DataFrame, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(ticker, date, feature, z): every column of ``rows`` less the training mean, by the training sample deviation."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(assembler(columns).transform(train))
    out = scaler.transform(assembler(columns).transform(rows)).select("ticker", "date", F.posexplode(vector_to_array("scaled")).alias("_at", "z"))
    names = F.array(*[F.lit(c) for c in columns])
    return out.select("ticker", "date", names[F.col("_at")].alias("feature"), "z")


def importance(models: Mapping[str, PipelineModel], features: Sequence[str], weights: Mapping[str, float]) -> DataFrame:
    """Weighted feature importance over tree models, largest first (one row per feature)."""
    rows = []
    for name, m in models.items():
        for f, v in zip(features, m.stages[-1].featureImportances.toArray()):
            rows.append((f, float(v) * weights[name]))
    table = SparkSession.active().createDataFrame(rows, "feature string, part double")
    return table.groupBy("feature").agg(F.sum("part").alias("importance")).orderBy(F.desc("importance"), "feature")


def save_model(model: PipelineModel, path: str, metadata: DataFrame) -> None:
    model.write().overwrite().save(f"{path}/model")
    metadata.write.mode("overwrite").json(f"{path}/metadata")


def load_model(spark, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.json(f"{path}/metadata")


# -- ensemble rules -----------------------------------------------------------------------


def ensemble(rows: DataFrame, probs: Sequence[str], rets: Sequence[str], weights: Sequence[float] = (0.40, 0.35, 0.25)) -> DataFrame:
    """Weighted probability and return; confidence = 1 − 2·population spread of the
    probabilities, at least 0."""
    p = sum((F.col(c) * w for c, w in zip(probs, weights)), F.lit(0.0))
    r = sum((F.col(c) * w for c, w in zip(rets, weights)), F.lit(0.0))
    mean = sum((F.col(c) for c in probs), F.lit(0.0)) / len(probs)
    var = sum(((F.col(c) - mean) * (F.col(c) - mean) for c in probs), F.lit(0.0)) / len(probs)
    out = rows.withColumn("direction_prob", p).withColumn("predicted_return", r)
    return out.withColumn("confidence", F.greatest(1 - 2 * F.sqrt(var), F.lit(0.0))).withColumn("signal", ensemble_signal())


def ensemble_signal() -> Column:
    """Strong signals are tested before the plain ones on both sides."""
    p, r, c = F.col("direction_prob"), F.col("predicted_return"), F.col("confidence")
    return (
        F.when((p > 0.70) & (r > 3) & (c > 0.7), "STRONG_BUY")
        .when((p > 0.60) & (r > 1) & (c > 0.5), "BUY")
        .when((p < 0.30) & (r < -3) & (c > 0.7), "STRONG_SELL")
        .when((p < 0.40) & (r < -1) & (c > 0.5), "SELL")
        .otherwise("HOLD")
    )


def neutral_when_missing(universe: DataFrame, predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    out = universe.join(predictions, list(keys), "left")
    return out.fillna({"direction_prob": 0.5, "predicted_return": 0.0, "confidence": 0.0, "signal": "HOLD"})


def retrain_due(registry: DataFrame, today: Column, days: int = 90) -> DataFrame:
    """Models never trained or trained at least ``days`` ago."""
    age = F.datediff(today, "last_trained")
    return registry.withColumn("age_days", age).withColumn("retrain", (age.isNull() | (age >= days)).cast("int"))
