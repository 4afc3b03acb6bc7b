"""Panel forecast: history plus extrapolation, features, scoring, inverse scaling.

Replaces the per-market Python loop with one plan over every series:

1. scale each series to [70, 3000] and extrapolate its growth ratios
   (:mod:`panelcast.operators.extrapolate`);
2. append the forecast rows to the scaled history;
3. add calendar features and the lag frame over the combined series;
4. drop sentinel rows, score with a fitted model, map predictions back to
   the series' original units.

Every step is partitioned by ``code``; the series state carries ``n_hist``,
``xmin`` and ``xmax`` so no join back to per-series statistics is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.calendar_features import CALENDAR_COLUMNS, add_calendar_features
from panelcast.operators import extrapolate as X
from panelcast.operators import lags
from panelcast.operators.scale import range_unscale
from panelcast.operators.slices import check_strategy, series_positions

FEATURE_BASE = ["Y", *CALENDAR_COLUMNS]
CARRY = ("n_hist", "xmin", "xmax", "seq")
# Combined series order: date, then place in the series (keeps raw ties).
COMBINED_ORDER = ("dt", "seq")


def history_and_forecast(panel: DataFrame, horizon: int = X.HORIZON_DAYS,
                         cyclic: bool = False, strategy: str = "window",
                         order: tuple[str, ...] = ("dt",)) -> DataFrame:
    """``(code, dt, Y, n_hist, xmin, xmax, is_forecast, seq)``: scaled history + forecast.

    ``order`` orders the history (add a tie-break column for raw rows);
    ``strategy="balanced"`` builds the series state without per-series tasks.
    """
    state = X.scaled_series(panel, order=order, strategy=strategy)
    return X.history_with_forecast(state, horizon, cyclic, order=order)


def forecast_features(panel: DataFrame, n_lags: int = lags.DEFAULT_TRACKING_DAYS,
                      horizon: int = X.HORIZON_DAYS, cyclic: bool = False,
                      strategy: str = "window", order: tuple[str, ...] = ("dt",)) -> DataFrame:
    """Lag frame over history + forecast, sentinel rows dropped, label renamed ``Y``."""
    combined = add_calendar_features(
        history_and_forecast(panel, horizon, cyclic, strategy, order))
    framed = lags.lag_frame(combined, n_lags, columns=FEATURE_BASE, carry=CARRY,
                            order=COMBINED_ORDER, strategy=strategy)
    framed = lags.drop_sentinels(framed, columns=[c for c in framed.columns
                                                  if c.endswith("_day_before")])
    return lags.label_from_lag0(framed)


def _order_of(df: DataFrame) -> tuple[str, ...]:
    return COMBINED_ORDER if "seq" in df.columns else ("dt",)


def head_rows(df: DataFrame, n: str = "n_hist") -> DataFrame:
    """The first ``n`` rows of every series (``n`` a per-series column)."""
    rn = F.row_number().over(lags.series_window(order=_order_of(df)))
    return df.withColumn("_rn", rn).where(F.col("_rn") <= F.col(n)).drop("_rn")


def positional_mape(scored: DataFrame, pred: str = "prediction",
                    n_lags: int = lags.DEFAULT_TRACKING_DAYS,
                    strategy: str = "window") -> DataFrame:
    """Per-series MAPE of the first ``n_hist`` scored rows against the history.

    Scored row ``i`` sits ``N`` rows after history row ``i`` (the lag frame
    drops the first ``N`` rows), so its truth is the N-th lag of ``Y``: the
    source's position-wise pairing, reproduced exactly. Series whose scored
    rows do not cover the whole history are left out; rows whose truth is 0
    have no percentage error and are counted in ``n_zero_truth``.
    ``strategy="balanced"`` numbers rows without a per-series task.
    """
    check_strategy(strategy)
    truth = lags.lag_name("Y", n_lags)
    order = _order_of(scored)
    scored = scored.select("code", *order, "n_hist", pred, truth)
    if strategy == "balanced":
        head = (series_positions(scored, "code", order, size="_rows")
                .where((F.col("_rows") >= F.col("n_hist")) & (F.col("_pos") <= F.col("n_hist"))))
    else:
        w_all = lags.whole_series(order=_order_of(scored))
        head = (scored.withColumn("_rows", F.count(F.lit(1)).over(w_all))
                .where(F.col("_rows") >= F.col("n_hist")))
        head = head_rows(head)
    ape = F.abs(F.try_divide(F.col(pred) - F.col(truth), F.col(truth)))
    return head.groupBy("code").agg(
        F.avg(ape).alias("mape"), F.count(ape).alias("n_scored"),
        F.sum(F.when(F.col(truth) == 0, 1).otherwise(0)).alias("n_zero_truth"))


def score_and_unscale(features: DataFrame, model, pred: str = "prediction",
                      scale_for_model: bool = True) -> DataFrame:
    """Score with a fitted model and map predictions back to original units.

    With ``scale_for_model=True`` the model sees the scaled features (as the
    source does, although its model was fit on unscaled values).
    """
    if not scale_for_model:
        features = _unscale_features(features)
    scored = model.transform(features)
    return scored.withColumn(
        "unscale_pred", range_unscale(F.col(pred), F.col("xmin"), F.col("xmax")))


def _unscale_features(features: DataFrame) -> DataFrame:
    ycols = [c for c in features.columns if c == "Y" or c.startswith("Y_")]
    return features.select(*[
        range_unscale(F.col(c), F.col("xmin"), F.col("xmax")).alias(c) if c in ycols
        else F.col(c) for c in features.columns])


def panel_forecast(panel: DataFrame, model, n_lags: int = lags.DEFAULT_TRACKING_DAYS,
                   horizon: int = X.HORIZON_DAYS, cyclic: bool = False,
                   pred: str = "prediction", scale_for_model: bool = True,
                   strategy: str = "window", order: tuple[str, ...] = ("dt",)) -> DataFrame:
    """``(code, dt, unscale_pred)`` for every row of every series' combined frame."""
    feats = forecast_features(panel, n_lags, horizon, cyclic, strategy, order)
    scored = score_and_unscale(feats, model, pred, scale_for_model)
    return scored.select("code", "dt", "unscale_pred")
