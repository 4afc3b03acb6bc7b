"""Registered model queries.

Training data is the lag frame of panel A after the sentinel filter, written
as parquet into the session's checkpoint folder and split by date; every fit
re-reads that table. The source's settings are used throughout (27 trees of
depth 10, refit with 29, cross-validation over depth {5, 6} x rate {0.1, 0.4}).

Boosted trees have no SQL form, so the oracles check what does not depend on a
booster: which rows are scored and that every score is finite, names and data
ranges of the features, the selection on a planted target (which has one
right answer), reloaded models row by row, fold numbers and the choice of the
best parameters. The forecast queries use a fixed linear model, which SQL can follow.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from panelcast.operators import forecast as FC
from panelcast.operators import boosting, metrics, ml, trees
from panelcast.operators.split import mark_split
from panelcast.plans import panels
from panelcast.plans.oracle_sql import with_ctes
from panelcast.plans.queries_forecast import _COMB, _CYC, _W, LOG_DECIMALS
from panelcast.plans.queries_panel import _MODEL_COLS, _SPLIT_CTE, model_frame_a
from panelcast.plans.registry import register
from panelcast.session import materialize, scratch_path
from panelcast.sources import packed, sinks

FEATURES = [c for c in _MODEL_COLS if c != "Y"]
FIRST = {"max_iter": ml.FIRST_FIT["maxIter"], "max_depth": ml.FIRST_FIT["maxDepth"],
         "step_size": ml.FIRST_FIT["stepSize"]}
REFIT = {"max_iter": ml.REFIT["maxIter"], "max_depth": ml.REFIT["maxDepth"],
         "step_size": ml.REFIT["stepSize"]}
# The planted target: second half of the year or not, which one feature tells exactly.
PLANTED = "month_000_day_before"

SCORED_SQL = with_ctes(_SPLIT_CTE, "SELECT code, dt, Y, TRUE AS finite FROM marked WHERE NOT is_train")


def training_frames(spark, sf_dir):
    """``(train, test, features)`` over the written model frame."""
    marked = mark_split(model_frame_a(spark, sf_dir))
    train = marked.where(F.col("is_train")).drop("is_train")
    test = marked.where(~F.col("is_train")).drop("is_train")
    return train, test, ml.feature_columns(train)


def _first_fit(spark, sf_dir):
    train, test, feats = training_frames(spark, sf_dir)
    return ml.fit_pipeline(train, feats, ml.gbt(**FIRST)), train, test, feats


def finite(pred: str):
    x = F.col(pred)
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def _scored(df, pred: str = "prediction"):
    return df.select("code", "dt", "Y", finite(pred).alias("finite"))


def _ranges(train, features):
    """(name, lo, hi): smallest and largest value of every feature on train."""
    row = train.agg(*[f(c) for c in features for f in (F.min, F.max)]).first()
    rows = [(c, float(row[2 * i]), float(row[2 * i + 1])) for i, c in enumerate(features)]
    return train.sparkSession.createDataFrame(rows, "name string, lo double, hi double")


_RANGE_SQL = ("SELECT name, min(value) AS lo, max(value) AS hi FROM (UNPIVOT (SELECT "
              + ", ".join(FEATURES) + " FROM marked WHERE is_train) ON "
              + ", ".join(FEATURES) + " INTO NAME name VALUE value) GROUP BY name")
_NAMES_SQL = ("SELECT unnest(range(" + str(len(FEATURES)) + ")) AS idx, unnest(["
              + ", ".join(f"'{c}'" for c in FEATURES) + "]) AS name")
_FEATURE_CTE = {**_SPLIT_CTE, "ranges": _RANGE_SQL, "names": _NAMES_SQL}


@register("gbt_fit_predict", SCORED_SQL)
def q_gbt_fit_predict(spark, sf_dir):
    """Fit on train, predict test."""
    model, _, test, _ = _first_fit(spark, sf_dir)
    return _scored(model.transform(test))


@register("gbt_mape_train_test", with_ctes(_SPLIT_CTE, """
SELECT CASE WHEN is_train THEN 'train' ELSE 'test' END AS split,
       count(nullif(Y, 0)) AS n_scored,
       CAST(sum(CASE WHEN Y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero_truth, TRUE AS finite
FROM marked GROUP BY 1"""))
def q_gbt_mape_train_test(spark, sf_dir):
    """Model MAPE on train and test, truth and prediction taken from the same row."""
    model, train, test, _ = _first_fit(spark, sf_dir)
    tr = model.transform(train).withColumn("split", F.lit("train"))
    te = model.transform(test).withColumn("split", F.lit("test"))
    both = tr.unionByName(te).select("split", "Y", "prediction")
    return metrics.mape(both, by=["split"], decimals=4).select(
        "split", "n_scored", "n_zero_truth", finite("mape").alias("finite"))


@register("gbt_early_stop", with_ctes(_SPLIT_CTE, """
SELECT code, dt, Y, TRUE AS finite, TRUE AS stopped_at_best, TRUE AS stopped_in_time
FROM marked WHERE NOT is_train"""))
def q_gbt_early_stop(spark, sf_dir):
    """Boosting that stops after 5 rounds without gain on the latest dates of train
    (never on test): rounds after the stop are not fitted."""
    train, test, feats = training_frames(spark, sf_dir)
    vectors = ml.assembler(feats)
    done = boosting.boost(vectors.transform(ml.mark_validation_tail(train)))
    errors = [r.rmse for r in done.history.where("set = 'validation'").orderBy("round").collect()]
    at_best = errors[done.rounds - 1] == min(errors)
    in_time = len(errors) == done.fitted == min(ml.FIRST_FIT["maxIter"], done.rounds + ml.PATIENCE)
    return _scored(done.model.transform(vectors.transform(test))).withColumns(
        {"stopped_at_best": F.lit(at_best), "stopped_in_time": F.lit(in_time)})


@register("feature_importance", with_ctes(_FEATURE_CTE, """
SELECT CAST(idx AS INTEGER) AS idx, name, lo, hi, CAST(1 AS DOUBLE) AS total, TRUE AS ordered
FROM names JOIN ranges USING (name)"""))
def q_feature_importance(spark, sf_dir):
    """Importances of the first fit: every feature once, summing to 1, highest first."""
    model, train, _, feats = _first_fit(spark, sf_dir)
    assembled = model.stages[0].transform(train)
    table = ml.importance_table(spark, model.stages[-1].featureImportances, assembled)
    rows = table.collect()  # one per feature
    ordered = all(a.score >= b.score for a, b in zip(rows, rows[1:]))
    total = round(sum(r.score for r in rows), 9)
    return (table.join(_ranges(train, feats), "name")
            .select("idx", "name", "lo", "hi", F.lit(total).alias("total"), F.lit(ordered).alias("ordered")))


def _planted(spark, sf_dir):
    train, _, feats = training_frames(spark, sf_dir)
    return materialize(train.withColumn("Y", F.when(F.col(PLANTED) >= 7, 1.0).otherwise(0.0)), "planted"), feats


@register("feature_total_gain", with_ctes(_FEATURE_CTE, f"""
SELECT CAST(idx AS INTEGER) AS idx, name, CAST(CASE WHEN name = '{PLANTED}' THEN 1 ELSE 0 END AS BIGINT) AS n_splits,
       round(CASE WHEN name = '{PLANTED}' THEN (SELECT count(*) * avg(CASE WHEN {PLANTED} >= 7 THEN 1.0 ELSE 0.0 END)
                                                      * (1 - avg(CASE WHEN {PLANTED} >= 7 THEN 1.0 ELSE 0.0 END))
                                               FROM marked WHERE is_train) ELSE 0.0 END, 4) AS total_gain
FROM names"""))
def q_feature_total_gain(spark, sf_dir):
    """Squared error that each feature's splits remove, from the nodes of the saved
    booster: on the planted target one split removes all of it."""
    train, feats = _planted(spark, sf_dir)
    model = ml.fit_pipeline(train, feats, ml.gbt(**FIRST))
    return trees.gain_table(model.stages[-1], feats).withColumn("total_gain", F.round("total_gain", 4))


def _selected(spark, sf_dir, selector_type):
    train, feats = _planted(spark, sf_dir)
    assembled = ml.assembler(feats).transform(train)
    sel = ml.FeatureImpSelector(estimator=ml.gbt(**FIRST), selectorType=selector_type,
                                numTopFeatures=int(len(feats) * ml.SELECT_FRACTION),
                                threshold=ml.SELECT_THRESHOLD, outputCol="features_subset")
    rows = [(rank, int(i), feats[int(i)]) for rank, i in enumerate(sel.fit(assembled).getIndices())]
    return (spark.createDataFrame(rows, "rank int, idx int, name string")
            .join(_ranges(train, feats), "name").select("rank", "idx", "name", "lo", "hi"))


_RANKED_SQL = f"""
SELECT CAST(row_number() OVER (ORDER BY CASE WHEN name = '{PLANTED}' THEN 0 ELSE 1 END, idx) - 1 AS INTEGER) AS rank,
       CAST(idx AS INTEGER) AS idx, name, lo, hi FROM names JOIN ranges USING (name)"""


@register("feature_select_topn", with_ctes(_FEATURE_CTE, f"""
SELECT * FROM ({_RANKED_SQL}) WHERE rank < {int(len(FEATURES) * ml.SELECT_FRACTION)}"""))
def q_feature_select_topn(spark, sf_dir):
    """Top ``int(0.7 * #features)`` features by importance, on the planted target."""
    return _selected(spark, sf_dir, "numTopFeatures")


@register("feature_select_threshold", with_ctes(_FEATURE_CTE, f"""
SELECT * FROM ({_RANKED_SQL}) WHERE rank = 0"""))
def q_feature_select_threshold(spark, sf_dir):
    """Features with importance strictly above 0.01, on the planted target."""
    return _selected(spark, sf_dir, "threshold")


@register("selector_save_load", with_ctes(_FEATURE_CTE, f"""
SELECT * FROM ({_RANKED_SQL}) WHERE rank < {int(len(FEATURES) * ml.SELECT_FRACTION)}"""))
def q_selector_save_load(spark, sf_dir):
    """An unfitted pipeline of assembler and selector, saved, loaded and fitted on the planted target."""
    train, feats = _planted(spark, sf_dir)
    selector = ml.FeatureImpSelector(estimator=ml.gbt(**FIRST), numTopFeatures=int(len(feats) * ml.SELECT_FRACTION),
                                     outputCol="features_subset")
    path = scratch_path(spark, "selector-pipeline")
    Pipeline(stages=[ml.assembler(feats), selector]).write().save(path)
    slicer = Pipeline.load(path).fit(train).stages[-1]
    rows = [(rank, int(i), feats[int(i)]) for rank, i in enumerate(slicer.getIndices())]
    return (spark.createDataFrame(rows, "rank int, idx int, name string")
            .join(_ranges(train, feats), "name").select("rank", "idx", "name", "lo", "hi"))


def _refit(spark, sf_dir, top_fraction):
    """Refit on the features that the first fit split on, ranked by total gain."""
    model, train, test, feats = _first_fit(spark, sf_dir)
    ranked = trees.ranked_by_gain(model.stages[-1])
    keep = [feats[i] for i in ml.select_split_on(ranked, top_fraction)]
    return _scored(ml.fit_pipeline(train, keep, ml.gbt(**REFIT)).transform(test))


@register("gbt_refit_selected", SCORED_SQL)
def q_gbt_refit_selected(spark, sf_dir):
    """Refit on the features the first model split on; predict test."""
    return _refit(spark, sf_dir, None)


@register("gbt_refit_top_fraction", SCORED_SQL)
def q_gbt_refit_top_fraction(spark, sf_dir):
    """Refit on the best 70 % of the features the first model split on."""
    return _refit(spark, sf_dir, ml.SELECT_FRACTION)


@register("gbt_selector_pipeline", SCORED_SQL)
def q_gbt_selector_pipeline(spark, sf_dir):
    """``[assembler, importance selector, regressor on the subset]`` as one Pipeline."""
    train, test, feats = training_frames(spark, sf_dir)
    pipe = ml.selection_pipeline(feats, ml.gbt(**FIRST),
                                 ml.gbt(**REFIT, features_col="features_subset",
                                        prediction_col="prediction_2"))
    return _scored(pipe.fit(train).transform(test), "prediction_2")


_CV_GRID = len(ml.CV_DEPTHS) * len(ml.CV_STEPS)


def _chosen(model):
    """Number of parameter sets tried, and whether the best model has the best one's settings."""
    at = min(range(len(model.avgMetrics)), key=model.avgMetrics.__getitem__)
    best = {p.name: v for p, v in model.getEstimatorParamMaps()[at].items()}
    booster = model.bestModel.stages[-1]
    same = all(booster.getOrDefault(booster.getParam(n)) == v for n, v in best.items())
    return F.lit(len(model.avgMetrics)).alias("n_metrics"), F.lit(same).alias("best_chosen")


@register("gbt_cross_validate", with_ctes(_SPLIT_CTE, f"""
SELECT code, dt, Y, TRUE AS finite, {_CV_GRID} AS n_metrics, TRUE AS best_chosen
FROM marked WHERE NOT is_train"""))
def q_gbt_cross_validate(spark, sf_dir):
    """3-fold CV over depth x rate, best model refit, predictions on test."""
    train, test, feats = training_frames(spark, sf_dir)
    model = ml.cross_validate_in_one_pass(ml.cross_validator(feats, ml.gbt(max_iter=ml.CV_ROUNDS)), train)
    return _scored(model.transform(test)).select("*", *_chosen(model))


@register("gbt_cross_validate_time_folds", with_ctes(_SPLIT_CTE, f"""
SELECT code, dt, CAST(floor(date_diff('day', lo, dt) * {ml.CV_FOLDS} / (date_diff('day', lo, hi) + 1)) AS INTEGER) AS fold,
       TRUE AS finite, {_CV_GRID} AS n_metrics, TRUE AS best_chosen
FROM (SELECT code, dt, min(dt) OVER () AS lo, max(dt) OVER () AS hi FROM marked WHERE is_train)"""))
def q_gbt_cross_validate_time_folds(spark, sf_dir):
    """CV with folds that are contiguous date ranges of train (``foldCol``)."""
    train, _, feats = training_frames(spark, sf_dir)
    train = ml.mark_time_folds(train)
    model = ml.cross_validate_in_one_pass(
        ml.cross_validator(feats, ml.gbt(max_iter=ml.CV_ROUNDS), fold_col="fold"), train)
    return model.transform(train).select("code", "dt", "fold", finite("prediction").alias("finite"), *_chosen(model))


@register("model_save_load", with_ctes(
    _SPLIT_CTE, "SELECT code, dt, Y, TRUE AS same FROM marked WHERE NOT is_train"))
def q_model_save_load(spark, sf_dir):
    """Save the fitted pipeline to the shared folder, load it, compare its scores of test."""
    model, _, test, _ = _first_fit(spark, sf_dir)
    loaded = ml.load_pipeline_model(ml.save_model(model, scratch_path(spark, "gbt-model")))
    before = model.transform(test).withColumnRenamed("prediction", "before").drop("features")
    return loaded.transform(before).select("code", "dt", "Y", (F.col("prediction") == F.col("before")).alias("same"))


# A fixed linear model over two lags of the target.
LINEAR = "0.75 * Y_001_day_before + 0.25 * Y_003_day_before"


def linear_model():
    return SQLTransformer(statement=f"SELECT *, {LINEAR} AS prediction FROM __THIS__")


def signed_log(x: str) -> str:
    """Order-keeping log of values that span many magnitudes (both SQL dialects)."""
    return f"ROUND(sign({x}) * ln(1 + abs({x})), {LOG_DECIMALS})"


_FORECAST = dict(_COMB)
_FORECAST["ends"] = "SELECT DISTINCT code, xmin, xmax, n FROM st"
_FORECAST["scored"] = ("SELECT l.code, dt, prediction, xmin, xmax, n AS n_hist, Y_005_day_before AS truth, "
                       "(xmax - xmin) * (prediction - CAST(70 AS DOUBLE)) / CAST(2930 AS DOUBLE) + xmin AS unscale_pred "
                       f"FROM (SELECT *, {LINEAR} AS prediction FROM lagged) l JOIN ends USING (code)")
FORECAST_SQL = with_ctes(_FORECAST, f"SELECT code, dt, {signed_log('unscale_pred')} AS log_pred FROM scored")


def _forecast(spark, sf_dir, **kw):
    return FC.panel_forecast(panels.panel_a(spark, sf_dir), linear_model(), **kw)


def _logged(forecast):
    return forecast.select("code", "dt", F.expr(signed_log("unscale_pred")).alias("log_pred"))


@register("forecast_all_codes", FORECAST_SQL)
def q_forecast_all_codes(spark, sf_dir):
    """History + literal extrapolation for every series, scored and unscaled."""
    return _logged(_forecast(spark, sf_dir))


def _unscaled(c: str) -> str:
    return f"((xmax - xmin) * ({c} - CAST(70 AS DOUBLE)) / CAST(2930 AS DOUBLE) + xmin)"


_UNSCALED_PRED = LINEAR.replace("Y_001_day_before", _unscaled("Y_001_day_before")).replace(
    "Y_003_day_before", _unscaled("Y_003_day_before"))


@register("forecast_unscaled_features", with_ctes(
    _FORECAST, f"SELECT code, dt, {signed_log(_unscaled('p'))} AS log_pred FROM "
    f"(SELECT code, dt, xmin, xmax, {_UNSCALED_PRED} AS p FROM lagged JOIN ends USING (code))"))
def q_forecast_unscaled_features(spark, sf_dir):
    """The forecast with a model that sees the target's lags in original units."""
    return _logged(_forecast(spark, sf_dir, scale_for_model=False))


_CYCLIC = dict(_CYC)
_CYCLIC["comb"] = ("SELECT code, dt, Y FROM st UNION ALL "
                   "SELECT code, CAST(last_dt + CAST(m + q * n AS INTEGER) AS DATE) AS dt, "
                   "exp(ln(last_y) + q * ln_cycle + ln_prefix) AS Y FROM ex")
_CYCLIC |= {k: _FORECAST[k] for k in ("cal", "lagged", "ends", "scored")}


@register("forecast_cyclic", with_ctes(
    _CYCLIC, f"SELECT code, dt, {signed_log('unscale_pred')} AS log_pred FROM scored"))
def q_forecast_cyclic(spark, sf_dir):
    """The forecast over the whole horizon, growth ratios repeated in cycles."""
    return _logged(_forecast(spark, sf_dir, cyclic=True))


@register("forecast_csv_sink", FORECAST_SQL)
def q_forecast_csv_sink(spark, sf_dir):
    """Forecast written as one CSV file per series, read back."""
    path = sinks.write_forecast_csv(_forecast(spark, sf_dir), scratch_path(spark, "forecast"))
    return _logged(sinks.read_forecast_csv(spark, path))


@register("forecast_packed_sink", FORECAST_SQL)
def q_forecast_packed_sink(spark, sf_dir):
    """Forecast written as packed files with a manifest, read back by its byte ranges."""
    path = scratch_path(spark, "packed-forecast")
    packed.write_packed_csv(_forecast(spark, sf_dir), path)
    return _logged(packed.read_packed_csv(spark, path))


@register("forecast_mape_by_code", with_ctes(_FORECAST, f"""
SELECT code, ROUND(avg(abs((prediction - truth) / nullif(truth, 0))), {LOG_DECIMALS}) AS mape,
       count(abs((prediction - truth) / nullif(truth, 0))) AS n_scored,
       CAST(sum(CASE WHEN truth = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero_truth
FROM (SELECT *, row_number() OVER ({_W}) AS i, count(*) OVER (PARTITION BY code) AS n_rows FROM scored)
WHERE n_rows >= n_hist AND i <= n_hist GROUP BY code"""))
def q_forecast_mape_by_code(spark, sf_dir):
    """Per-series MAPE of the model on the combined frame, position-wise as in the source."""
    scored = FC.score_and_unscale(FC.forecast_features(panels.panel_a(spark, sf_dir)), linear_model())
    return FC.positional_mape(scored, "prediction").withColumn("mape", F.round("mape", LOG_DECIMALS))
