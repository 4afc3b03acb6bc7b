"""End-to-end flows over a raw measurement table, composed of the operators.

* :func:`cv_training_flow` -- raw table -> panel -> calendar -> lag frame ->
  sentinel filter -> time split -> cross-validated boosted trees -> MAPE on
  train and test -> optional model save.
* :func:`select_refit_forecast_flow` -- first fit -> keep the features the
  model split on -> refit -> forecast every series (history + ratio
  extrapolation, features, scoring, inverse scaling) -> per-series MAPE ->
  optional per-series CSV output.

Both keep every step a distributed DataFrame plan. The model frame is
written to the shared checkpoint folder once and re-read by every fit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.calendar_features import CALENDAR_COLUMNS, add_calendar_features
from panelcast.operators import forecast as FC, trees
from panelcast.operators import lags, metrics, ml
from panelcast.operators.panel import build_panel
from panelcast.operators.split import mark_split
from panelcast.session import materialize
from panelcast.sources import sinks
from panelcast.sources.readers import ORDINAL

FEATURE_BASE = ["Y", *CALENDAR_COLUMNS]


@dataclass
class TrainingData:
    panel: DataFrame
    train: DataFrame
    test: DataFrame
    features: list[str]
    order: tuple[str, ...] = ("dt",)


def training_data(raw: DataFrame, n_lags: int = lags.DEFAULT_TRACKING_DAYS,
                  date_format: str | None = None, aggregate: bool = True,
                  decimals: int | None = None, strategy: str = "window",
                  tie_break: str = ORDINAL) -> TrainingData:
    """Panel and the split, materialised model frame of a raw table.

    ``strategy`` is passed to the lag frame (choose ``"balanced"`` when one
    series may be very long, which is possible when the raw rows are not
    aggregated per date). Without aggregation, rows that share a date are
    ordered by the column ``tie_break``; readers add the input order as
    ``_ord`` on request.
    """
    keep: tuple[str, ...] = ()
    order: tuple[str, ...] = ("dt",)
    if not aggregate:
        if tie_break not in raw.columns:
            raise ValueError(f"raw rows need the tie-break column {tie_break!r}; read them "
                             "with ordinal=True or name another column")
        keep, order = (tie_break,), ("dt", tie_break)
    panel = build_panel(raw, date_format=date_format, aggregate=aggregate, decimals=decimals,
                        keep=keep)
    frame = lags.lag_frame(add_calendar_features(panel), n_lags, columns=FEATURE_BASE,
                           order=order, strategy=strategy)
    frame = lags.label_from_lag0(lags.drop_sentinels(frame))
    marked = mark_split(materialize(frame, "model-frame"))
    train = marked.where(F.col("is_train")).drop("is_train")
    test = marked.where(~F.col("is_train")).drop("is_train")
    return TrainingData(panel, train, test, ml.feature_columns(train), order)


def _mape_train_test(model, data: TrainingData, pred: str = "prediction") -> DataFrame:
    tr = model.transform(data.train).select("Y", pred, F.lit("train").alias("split"))
    te = model.transform(data.test).select("Y", pred, F.lit("test").alias("split"))
    return metrics.mape(tr.unionByName(te), pred=pred, by=["split"], decimals=4)


def cv_training_flow(raw: DataFrame, estimator=None, depths=ml.CV_DEPTHS, steps=ml.CV_STEPS,
                     folds: int = ml.CV_FOLDS, save_path: str | None = None, **kw):
    """Cross-validated fit; returns ``(cv_model, mape_by_split)``."""
    data = training_data(raw, **kw)
    est = estimator if estimator is not None else ml.gbt()
    cv_model = ml.cross_validator(data.features, est, depths, steps, folds).fit(data.train)
    if save_path:
        ml.save_model(cv_model, save_path)
    return cv_model, _mape_train_test(cv_model, data, est.getPredictionCol())


def select_refit_forecast_flow(raw: DataFrame, first=None, refit=None,
                               top_fraction: float | None = None,
                               horizon: int = FC.X.HORIZON_DAYS, cyclic: bool = False,
                               out_dir: str | None = None, scale_for_model: bool = True, **kw):
    """Fit, select, refit, forecast every series.

    Returns ``(model, selected_features, mape_by_split, forecast, mape_by_code)``;
    ``forecast`` is ``(code, dt, unscale_pred)`` and is written as one CSV
    folder per series when ``out_dir`` is given.
    """
    data = training_data(raw, **kw)
    first = first if first is not None else ml.gbt(**_args(ml.FIRST_FIT))
    refit = refit if refit is not None else ml.gbt(**_args(ml.REFIT))
    model = ml.fit_pipeline(data.train, data.features, first)
    ranked = trees.ranked_by_gain(model.stages[-1])
    keep = [data.features[i] for i in ml.select_split_on(ranked, top_fraction)]
    final = ml.fit_pipeline(data.train, keep, refit)
    strategy = kw.get("strategy", "window")
    n_lags = kw.get("n_lags", lags.DEFAULT_TRACKING_DAYS)
    pred = refit.getPredictionCol()
    feats = FC.forecast_features(data.panel, n_lags, horizon, cyclic, strategy, data.order)
    # Scored once and kept narrow: the CSV, the result and the per-series error all read it.
    scored = materialize(
        FC.score_and_unscale(feats, final, pred, scale_for_model)
        .select("code", "dt", "seq", "n_hist", pred, lags.lag_name("Y", n_lags), "unscale_pred"), "scored")
    forecast = scored.select("code", "dt", "unscale_pred")
    if out_dir:
        sinks.write_forecast_csv(forecast, out_dir)
    by_code = FC.positional_mape(scored, pred, n_lags, strategy)
    return final, keep, _mape_train_test(final, data, pred), forecast, by_code


def _args(settings: dict) -> dict:
    return {"max_iter": settings["maxIter"], "max_depth": settings["maxDepth"],
            "step_size": settings["stepSize"]}
