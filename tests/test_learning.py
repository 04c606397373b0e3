"""Boosting stops at its best prefix; the random search finds what the full grid finds."""

import random

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from quantloom.operators import learn
from quantloom.operators.evaluation import auc
from quantloom.session import reliable

SETTINGS = {"labelCol": "label", "weightCol": "_w", "featuresCol": "features"}


@pytest.fixture(scope="module")
def planted(spark):
    """Three years of rows whose target follows two features smoothly."""
    rng, rows = random.Random(3), []
    for year in (2001, 2002, 2003):
        for k in range(700):
            a, b, noise = rng.random(), rng.random(), rng.random()
            y = 3 * a * a + b - 2 * a * b + 0.25 * rng.gauss(0, 1)
            rows.append((f"T{k:04}", f"{year}-{1 + k % 12:02}-15", a, b, noise, y, int(y > 1.0)))
    return reliable(spark.createDataFrame(rows, "ticker string, date string, a double, b double, noise double, target_regression double, target_binary int").withColumn("date", F.to_date("date")))


def test_planted_signal_trains_more_than_twenty_trees(planted):
    rows = learn.training_rows(planted, ["a", "b", "noise"])
    estimator = GBTClassifier(**SETTINGS, maxDepth=2, stepSize=0.1, seed=42)
    model, losses = learn.best_prefix(estimator, rows, patience=10, first=24, most=60)
    assert model.getNumTrees > 20
    kept = model.evaluateEachIteration(rows.where("is_validation"))
    assert kept == pytest.approx(losses[: len(kept)])  # fewer rounds are a prefix
    assert kept[-1] == min(losses)
    assert len(losses) == 60 or len(losses) - len(kept) >= 10


@pytest.mark.parametrize("kind", [GBTClassifier, GBTRegressor])
def test_cut_model_is_the_model_of_fewer_rounds(planted, kind, tmp_path):
    rows = learn.training_rows(planted, ["a", "b", "noise"])
    estimator = kind(**SETTINGS, maxDepth=2, stepSize=0.1, subsamplingRate=0.8, seed=42)
    cut, short = learn.cut_after(estimator.copy({estimator.maxIter: 8}).fit(rows), 5), estimator.copy({estimator.maxIter: 5}).fit(rows)
    assert cut.getNumTrees == 5 and cut.treeWeights == short.treeWeights and cut.getMaxIter() == 5
    assert cut.featureImportances == short.featureImportances and cut.numFeatures == 3
    cut.write().save(str(tmp_path / "cut"))
    for model in (cut, type(cut).load(str(tmp_path / "cut"))):
        both = model.transform(rows.withColumn("k", F.lit(1))).agg(F.sum("prediction"), F.count("k")).first()
        assert both == short.transform(rows.withColumn("k", F.lit(1))).agg(F.sum("prediction"), F.count("k")).first()


def test_boosting_is_trained_at_most_twice(planted, monkeypatch):
    rows, trained = learn.training_rows(planted, ["a", "b", "noise"]), []
    fit = GBTClassifier._fit
    monkeypatch.setattr(GBTClassifier, "_fit", lambda self, data: trained.append(self.getMaxIter()) or fit(self, data))
    _model, losses = learn.best_prefix(GBTClassifier(**SETTINGS, maxDepth=2, stepSize=0.1, seed=42), rows, patience=5, first=6, most=26)
    assert len(losses) > 12 and trained == [6, 26]


def test_looks_are_doubled_until_the_best_round_is_old():
    falling = [1.0 / k for k in range(1, 61)]
    assert learn._kept_rounds(falling, 5, 6, 60) == (60, 60)
    assert learn._kept_rounds(falling[:6], 5, 6, 60) == (0, 12)
    assert learn._kept_rounds([*falling[:10], *[1.0] * 50], 5, 6, 60) == (10, 24)
    assert learn._kept_rounds([*falling[:1], *[1.0] * 10, *[0.0] * 49], 5, 6, 60) == (1, 6)
    assert learn._kept_rounds(falling, 5, 80, 60) == (60, 60)


def test_no_validation_rows_keep_the_first_rounds(planted):
    rows = learn.training_rows(planted, ["a", "b"]).withColumn("is_validation", F.lit(False))
    model, losses = learn.best_prefix(GBTClassifier(**SETTINGS, maxDepth=2), rows, first=3)
    assert model.getNumTrees == 3 and losses == []


def test_search_is_not_worse_than_the_grid(planted):
    ranges = {"maxDepth": ("choice", [1, 4]), "stepSize": ("choice", [0.001, 0.2])}
    found = learn.search(planted, ["a", "b", "noise"], ranges, [2003], n=4, rounds=(4, 8), seed=1)
    rows = found.collect()
    assert [r.step for r in rows] == [1] * 4 + [2] * 2
    ready, test = learn.training_rows(planted.where("year(date) < 2003"), ["a", "b", "noise"]), planted.where("year(date) = 2003")
    grid = []
    for depth in (1, 4):
        for size in (0.001, 0.2):
            model = GBTClassifier(**SETTINGS, maxDepth=depth, stepSize=size, maxIter=8, seed=1).fit(ready)
            scored = learn.probability(model, learn.assembler(["a", "b", "noise"]).transform(test), "score")
            grid.append(auc(scored.select(F.lit(1).alias("k"), "score", "target_binary"), ["k"]).first().auc)
    winner = next(r for r in rows if r.step == 2 and r.place == 1)
    assert winner.mean_score >= max(grid) - 1e-9
    worse = learn.search(planted, ["a", "b"], ranges, [2003], metric="rmse", n=2, rounds=(2,), seed=1).collect()
    assert worse[0].mean_score <= worse[1].mean_score


def test_draws_are_seeded_and_different():
    a, b = learn.draw_parameters(learn.RANGES, 12, 5), learn.draw_parameters(learn.RANGES, 12, 5)
    assert a == b and len({str(x) for x in a}) == 12
    assert all(2 <= x["maxDepth"] <= 6 and 0.02 <= x["stepSize"] <= 0.3 for x in a)
