"""O: learning. Model outputs have no SQL equivalent and are checked for rows only."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators import evaluation, learn, weights
from quantloom.operators.xsection import pct_rank
from quantloom.plans import walkforward
from quantloom.plans.monthly import cross_section
from quantloom.session import reliable, scratch
from quantloom.suite.oracle import add_cte, rank_sql
from quantloom.suite.registry import case

#: Columns that are standardised: all raw features and both market columns.
STANDARDISED = [*learn.MODEL_RAW, "market_volatility", "market_trend"]

add_cte("tgtrows", "SELECT t.ticker, t.date, year(t.date) AS year, target_binary, future_return_resid, score FROM tgt t JOIN scores s ON s.ticker = t.ticker AND s.date = t.date WHERE target_binary IS NOT NULL AND score IS NOT NULL")
add_cte("folds", """SELECT f.y AS test_year, 'train' AS part, t.* FROM tgtrows t JOIN (SELECT DISTINCT year AS y FROM tgtrows WHERE year >= (SELECT min(year) + 3 FROM tgtrows)) f ON t.year < f.y
  UNION ALL SELECT year, 'test', t.* FROM tgtrows t WHERE year >= (SELECT min(year) + 3 FROM tgtrows)""")


@case("o01_expanding_folds", "test_year:i part n:i first_date:d last_date:d", "SELECT test_year, part, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM folds GROUP BY 1, 2")
def _(m):
    rows = reliable(m.scored_targets())
    out = learn.expanding_folds(rows, *learn.test_years(rows))
    return out.groupBy("test_year", "part").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@case("o02_date_split", "ticker date:d part", "SELECT ticker, date, CASE WHEN date <= DATE '1999-12-31' THEN 'train' WHEN date <= DATE '2000-12-31' THEN 'validation' ELSE 'test' END AS part FROM tgtrows")
def _(m):
    return learn.date_split(m.scored_targets(), "1999-12-31", "2000-12-31")


@case("o03_latest_share", "ticker date:d is_validation:i", "SELECT ticker, date, CASE WHEN row_number() OVER (ORDER BY date, ticker) <= floor((SELECT count(*) FROM tgtrows) * 0.8) THEN 0 ELSE 1 END AS is_validation FROM tgtrows")
def _(m):
    return learn.latest_share(reliable(m.scored_targets()))


@case("o04_decay_weights", "ticker date:d sample_weight:8", "SELECT ticker, date, raw * count(*) OVER () / sum(raw) OVER () AS sample_weight FROM (SELECT *, exp(-0.02::DOUBLE * ((SELECT max(date) FROM tgtrows) - date) / 30.0) AS raw FROM tgtrows)")
def _(m):
    return learn.decay_weights(reliable(m.scored_targets()))


def _features(m):
    """Model rows: month-end features with ranks and targets, written once."""
    if not hasattr(m, "_model_rows"):
        columns = [*learn.MODEL_RAW, *[f"{c}_rank" for c in learn.MODEL_RAW], "market_volatility", "market_trend"]
        rows = cross_section(m.month_rows())
        m._model_columns = columns
        m._model_rows = reliable(rows.select("ticker", "date", *columns, "target_binary", "target_regression", "future_return_resid", "future_return_resid_rank"))
    return m._model_rows, m._model_columns


def _last_fold(m):
    rows, columns = _features(m)
    year = learn.test_years(rows)[1]
    train = rows.where(F.year("date") < year).dropna(subset=["target_binary", "target_regression", *columns])
    return train, rows.where(F.year("date") == year).fillna(0.0, columns), columns


@case("o05_boosted_classifier", "ticker date:d test_year:i trees:i pred_proba:6")
def _(m):
    rows, columns = _features(m)
    return walkforward.fold_scores(rows, columns, walkforward.boosted_scorer(columns))


@case("o05_best_prefix", "test_year:i seed:i beaten:i impatient:i", f"SELECT y AS test_year, seed, 0 AS beaten, 0 AS impatient FROM (SELECT DISTINCT year(date) AS y FROM scores WHERE year(date) >= (SELECT min(year(date)) + 3 FROM scores)) CROSS JOIN (VALUES {', '.join(f'({s})' for s in learn.SEEDS)}) v(seed)")
def _(m):
    """Per fold and seed: whether a shorter prefix has a lower loss than the kept one, and whether training ended early without patience."""
    from pyspark.ml.classification import GBTClassifier

    rows, columns = _features(m)
    first, last = learn.test_years(rows)

    def look(year, seed, ready):
        model, losses = learn.best_prefix(GBTClassifier(labelCol="label", weightCol="_w", **learn.tree_settings(learn.ROUNDS, 4, seed)), ready)
        kept = model.evaluateEachIteration(ready.where("is_validation"))
        early = len(losses) < learn.ROUNDS and len(losses) - len(kept) < learn.PATIENCE
        return year, seed, int(any(loss < kept[-1] - 1e-9 for loss in losses)), int(early)

    ready = {y: learn.training_rows(walkforward.fold_rows(rows, columns, y, "target_binary")[0], columns) for y in range(first, last + 1)}
    found = learn.side_by_side([partial(look, y, s, ready[y]) for y in ready for s in learn.SEEDS])
    return m.spark.createDataFrame(found, "test_year int, seed int, beaten int, impatient int")


@case("o06_boosted_regressor", "ticker date:d prediction:6 rank_score:6")
def _(m):
    rows, columns = _features(m)
    scored = walkforward.fold_scores(rows, columns, walkforward.regression_scorer(columns), target="target_regression")
    scored = reliable(scored.select("ticker", "date", "prediction"))
    return pct_rank(scored, ["date"], {"prediction": "rank_score"})


@case("o07_meta_ensemble", "ticker date:d pred_proba:6")
def _(m):
    rows, columns = _features(m)
    return walkforward.fold_scores(rows, columns, walkforward.families_scorer(columns))


@case("o08_stacked_blend", "ticker date:d pred_proba:6")
def _(m):
    rows, columns = _features(m)
    return walkforward.fold_scores(rows, columns, walkforward.stacked_scorer(columns))


add_cte("ens", f"""SELECT ticker, date, score AS p1, {rank_sql('future_return_resid', 'date')} AS p2, 1 - score AS p3, (score - 0.5) * 20 AS r1, (score - 0.4) * 15 AS r2, (score - 0.6) * 10 AS r3 FROM tgtrows""")


@case("o09_ensemble_rules", "ticker date:d direction_prob:6 predicted_return:6 confidence:6 signal", """SELECT *, CASE WHEN direction_prob > 0.7 AND predicted_return > 3 AND confidence > 0.7 THEN 'STRONG_BUY' WHEN direction_prob > 0.6 AND predicted_return > 1 AND confidence > 0.5 THEN 'BUY'
  WHEN direction_prob < 0.3 AND predicted_return < -3 AND confidence > 0.7 THEN 'STRONG_SELL' WHEN direction_prob < 0.4 AND predicted_return < -1 AND confidence > 0.5 THEN 'SELL' ELSE 'HOLD' END AS signal FROM (
  SELECT ticker, date, p1 * 0.40::DOUBLE + p2 * 0.35::DOUBLE + p3 * 0.25::DOUBLE AS direction_prob, r1 * 0.40::DOUBLE + r2 * 0.35::DOUBLE + r3 * 0.25::DOUBLE AS predicted_return,
  greatest(1 - 2 * sqrt((pow(p1 - mu, 2) + pow(p2 - mu, 2) + pow(p3 - mu, 2)) / 3), 0) AS confidence FROM (SELECT *, (p1 + p2 + p3) / 3 AS mu FROM ens))""")
def _(m):
    rows = pct_rank(reliable(m.scored_targets()), ["date"], {"future_return_resid": "p2"})
    s = F.col("score")
    rows = rows.select("ticker", "date", s.alias("p1"), "p2", (1 - s).alias("p3"), ((s - 0.5) * 20).alias("r1"), ((s - 0.4) * 15).alias("r2"), ((s - 0.6) * 10).alias("r3"))
    return learn.ensemble(rows, ["p1", "p2", "p3"], ["r1", "r2", "r3"])


@case("o10_train_metrics", "year:i accuracy:6 precision:6 recall:6 f1:6 mae:6 mse:6 rmse:6 r2:5", """SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM (SELECT year, avg(CAST((score >= 0.8) = (target_binary = 1) AS DOUBLE)) AS accuracy,
  coalesce(count(*) FILTER (score >= 0.8 AND target_binary = 1) / nullif(count(*) FILTER (score >= 0.8), 0), 0) AS precision, coalesce(count(*) FILTER (score >= 0.8 AND target_binary = 1) / nullif(count(*) FILTER (target_binary = 1), 0), 0) AS recall,
  avg(abs(future_return_resid - score)) AS mae, avg(pow(future_return_resid - score, 2)) AS mse, sqrt(avg(pow(future_return_resid - score, 2))) AS rmse, 1 - avg(pow(future_return_resid - score, 2)) / var_pop(future_return_resid) AS r2 FROM tgtrows GROUP BY 1)""")
def _(m):
    rows = reliable(m.scored_targets())
    a = evaluation.classification(rows, ["year"], F.col("score") >= 0.8, F.col("target_binary") == 1)
    return a.join(evaluation.regression(rows, ["year"], "score", "future_return_resid"), "year")


@case("o11_auc", "year:i auc:8", f"SELECT year, (sum(CASE WHEN target_binary = 1 THEN rk ELSE 0 END) - p * (p + 1) / 2.0) / (p * (n - p)) AS auc FROM (SELECT *, ({rank_sql('score', 'year')}) * count(*) OVER (PARTITION BY year) AS rk, sum(target_binary) OVER (PARTITION BY year) AS p, count(*) OVER (PARTITION BY year) AS n FROM tgtrows) GROUP BY year, p, n")
def _(m):
    return evaluation.auc(reliable(m.scored_targets()), ["year"])


add_cte("qk", "SELECT *, row_number() OVER (PARTITION BY year ORDER BY score DESC, date, ticker) AS hi, row_number() OVER (PARTITION BY year ORDER BY score, date, ticker) AS lo, count(*) OVER (PARTITION BY year) AS n FROM tgtrows")
add_cte("quality", """SELECT year, avg(target_binary) AS base_rate, avg(target_binary) FILTER (hi <= 20) AS precision_n, avg(target_binary) FILTER (hi <= floor(n * 0.1)) AS precision_10, avg(target_binary) FILTER (hi <= floor(n * 0.05)) AS precision_5,
  avg(target_binary) FILTER (lo <= floor(n * 0.1)) AS bottom_decile, avg(target_binary) FILTER (hi <= floor(n * 0.1)) / avg(target_binary) AS lift FROM qk GROUP BY 1""")


@case("o12_precision_lift", "year:i base_rate:6 precision_n:6 precision_10:6 precision_5:6 bottom_decile:6 lift:6", "SELECT * FROM quality")
def _(m):
    return evaluation.yearly_quality(reliable(m.scored_targets()))


@case("o13_parameter_search", "metric params step:i rounds:i mean_score:6 n_splits:i place:i")
def _(m):
    rows, columns = _features(m)
    clean = reliable(rows.dropna(subset=["target_binary", "target_regression", *columns]))
    first, last = learn.test_years(clean)
    found = [learn.search(clean, columns, learn.RANGES, range(first, last + 1), metric).withColumn("metric", F.lit(metric)) for metric in ("auc", "rmse")]
    return found[0].unionByName(found[1])


@case("o14_feature_importance", "test_year:i feature importance:6")
def _(m):
    rows, columns = _features(m)
    first, last = learn.test_years(rows)

    def fold(year):
        models = learn.model_families(walkforward.fold_rows(rows, columns, year, "target_binary")[0], columns)
        return learn.importance({k: models[k] for k in ("boosted", "forest")}, columns, {"boosted": 0.6, "forest": 0.4}).withColumn("test_year", F.lit(year))

    return reduce(DataFrame.unionByName, learn.side_by_side([partial(fold, y) for y in range(first, last + 1)]))


add_cte("stdrows", "SELECT *, year(date) AS year FROM (" + " UNION ALL ".join(f"SELECT ticker, date, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM xs" for c in STANDARDISED) + ")")
add_cte("stdfull", "SELECT ticker, date, year(date) AS year FROM xs WHERE target_binary IS NOT NULL" + "".join(f" AND {c} IS NOT NULL" for c in STANDARDISED))


@case("o15_standardised_features", "test_year:i ticker date:d feature z:5", """SELECT f.test_year, r.ticker, r.date, r.feature, (coalesce(r.v, 0) - mean) / sd AS z FROM (
  SELECT y AS test_year, feature, avg(v) AS mean, stddev_samp(v) AS sd FROM (SELECT DISTINCT year AS y FROM stdrows WHERE year >= (SELECT min(year) + 3 FROM stdrows)) JOIN stdrows ON year < y SEMI JOIN stdfull ON stdfull.ticker = stdrows.ticker AND stdfull.date = stdrows.date GROUP BY 1, 2) f
  JOIN stdrows r ON r.year = f.test_year AND r.feature = f.feature""")
def _(m):
    rows, _columns = _features(m)
    first, last = learn.test_years(rows)
    parts = [learn.standardised(*walkforward.fold_rows(rows, STANDARDISED, y, "target_binary"), STANDARDISED).withColumn("test_year", F.lit(y)) for y in range(first, last + 1)]
    return reduce(DataFrame.unionByName, parts)


@case("o16_batch_scoring", "date:d ticker place:i pred_proba:6 weight:6 final_weight:6")
def _(m):
    from quantloom.operators import regime

    train, test, columns = _last_fold(m)
    newest = test.join(F.broadcast(test.agg(F.max("date").alias("date"))), "date", "left_semi")
    scored = learn.mean_probability(learn.boosted_classifiers(train, columns), newest)
    picks = weights.inverse_vol(weights.top_n(scored, 20, "pred_proba", position="place"))
    level = regime.risk_level(m.macro()).select("date", "position_scale")
    return picks.join(F.broadcast(level), "date").withColumn("final_weight", F.col("weight") * F.col("position_scale") * 100)


@case("o17_model_persistence", "test_year:i seed:i n_features:i n_trees:i n_scored:i mean_proba:6")
def _(m):
    """Every fold and seed written with its metadata, read back and used."""
    rows, columns = _features(m)
    first, last = learn.test_years(rows)

    def fold(year):
        train, test = walkforward.fold_rows(rows, columns, year, "target_binary")
        out = []
        for seed, model in zip(learn.SEEDS, learn.boosted_classifiers(train, columns)):
            path = scratch(m.spark, "model")
            about = m.spark.range(1).select(F.lit(year).alias("test_year"), F.lit(seed).alias("seed"), F.lit(len(columns)).alias("n_features"), F.lit(model.stages[-1].getNumTrees).alias("n_trees"))
            learn.save_model(model, path, about)
            loaded, metadata = learn.load_model(m.spark, path)
            scored = learn.probability(loaded, test, "p").agg(F.count(F.lit(1)).alias("n_scored"), F.avg("p").alias("mean_proba"))
            out.append(metadata.crossJoin(F.broadcast(scored)))
        return reduce(DataFrame.unionByName, out)

    return reduce(DataFrame.unionByName, learn.side_by_side([partial(fold, y) for y in range(first, last + 1)]))


@case("o18_retrain_due", "sector last_trained:d age_days:i retrain:i", """SELECT sector, coalesce(last_trained, DATE '1900-01-01') AS last_trained, coalesce(today - last_trained, -1) AS age_days, CASE WHEN coalesce(today - last_trained, 90) >= 90 THEN 1 ELSE 0 END AS retrain FROM (SELECT sector, max(date) FILTER (n >= 160) AS last_trained, (SELECT max(date) FROM prices) AS today FROM (
  SELECT sector, date_trunc('month', date) AS mo, max(date) AS date, count(*) AS n FROM prices p JOIN meta g ON g.ticker = p.ticker GROUP BY 1, 2) GROUP BY 1)""")
def _(m):
    rows = m.prices().join(m.meta().select("ticker", "sector"), "ticker")
    months = rows.groupBy("sector", F.trunc("date", "MM").alias("mo")).agg(F.max("date").alias("date"), F.count(F.lit(1)).alias("n"))
    registry = months.groupBy("sector").agg(F.max(F.when(F.col("n") >= 160, F.col("date"))).alias("last_trained"))
    today = m.prices().agg(F.max("date").alias("today"))
    due = learn.retrain_due(registry.crossJoin(F.broadcast(today)), F.col("today"))
    return due.withColumn("last_trained", F.coalesce("last_trained", F.lit("1900-01-01").cast("date"))).fillna(-1, ["age_days"])


@case("o19_neutral_prediction", "ticker date:d direction_prob:6 predicted_return:6 confidence:6 signal", "SELECT e.ticker, e.date, coalesce(score, 0.5) AS direction_prob, coalesce((score - 0.5) * 10, 0) AS predicted_return, coalesce(abs(score - 0.5) * 2, 0) AS confidence, CASE WHEN score IS NULL THEN 'HOLD' WHEN score > 0.5 THEN 'BUY' ELSE 'SELL' END AS signal FROM (SELECT t.ticker, m.date FROM (SELECT DISTINCT ticker FROM prices) t CROSS JOIN mends m) e JOIN (SELECT ticker, min(date) AS f FROM prices GROUP BY 1) a ON a.ticker = e.ticker AND e.date >= a.f LEFT JOIN (SELECT * FROM scores WHERE score IS NOT NULL) s ON s.ticker = e.ticker AND s.date = e.date")
def _(m):
    from quantloom.operators.asof import sample_at

    s = F.col("score")
    preds = m.scores().where("score IS NOT NULL").select("ticker", "date", s.alias("direction_prob"), ((s - 0.5) * 10).alias("predicted_return"), (F.abs(s - 0.5) * 2).alias("confidence"), F.when(s > 0.5, "BUY").otherwise("SELL").alias("signal"))
    everyone = sample_at(m.prices().select("ticker", "date"), m.month_ends()).select("ticker", "date")
    return learn.neutral_when_missing(everyone, preds, ["ticker", "date"])
