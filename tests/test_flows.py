"""End-to-end flows on the smallest provided tables (few, shallow trees)."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from panelcast.operators import ml
from panelcast.plans import flows, panels


def test_cv_training_flow(spark, tmp_dir):
    raw = panels.order_measurements(spark, SF_SMALL)
    cv_model, mape = flows.cv_training_flow(
        raw, estimator=ml.gbt(max_iter=2), depths=(2,), steps=(0.1, 0.4), decimals=2,
        save_path=f"{tmp_dir}/cv")
    assert len(cv_model.avgMetrics) == 2
    assert sorted(r["split"] for r in mape.collect()) == ["test", "train"]
    assert ml.load_cv_model(f"{tmp_dir}/cv").bestModel is not None


def test_select_refit_forecast_flow(spark, tmp_dir):
    raw = panels.order_measurements(spark, SF_SMALL)
    model, keep, mape, forecast, by_code = flows.select_refit_forecast_flow(
        raw, first=ml.gbt(max_iter=3, max_depth=3), refit=ml.gbt(max_iter=3, max_depth=3),
        decimals=2, out_dir=f"{tmp_dir}/fc")
    assert 0 < len(keep) <= 65
    n = forecast.count()
    assert n > 0 and forecast.where(F.col("unscale_pred").isNull()).count() == 0
    from panelcast.sources.sinks import read_forecast_csv
    assert read_forecast_csv(spark, f"{tmp_dir}/fc").count() == n
    assert by_code.count() > 0


def test_flow_on_raw_rows_keeps_ties(spark, tmp_dir):
    raw = panels.order_measurements(spark, SF_SMALL, keep=("o_orderkey",))
    with pytest.raises(ValueError, match="tie-break"):
        flows.training_data(raw, aggregate=False)
    data = flows.training_data(raw, aggregate=False, tie_break="o_orderkey")
    assert data.order == ("dt", "o_orderkey")
    assert data.train.count() + data.test.count() > 0
    _, _, _, forecast, _ = flows.select_refit_forecast_flow(
        raw, first=ml.gbt(max_iter=2, max_depth=2), refit=ml.gbt(max_iter=2, max_depth=2),
        aggregate=False, tie_break="o_orderkey", horizon=30, strategy="balanced")
    assert forecast.count() > 0


@pytest.mark.parametrize("n_lags", [3, 7])
def test_flow_passes_lags_and_prediction_column(spark, n_lags):
    raw = panels.order_measurements(spark, SF_SMALL)
    _, _, _, forecast, by_code = flows.select_refit_forecast_flow(
        raw, first=ml.gbt(max_iter=2, max_depth=2),
        refit=ml.gbt(max_iter=2, max_depth=2, prediction_col="guess"),
        decimals=2, n_lags=n_lags, top_fraction=0.7)
    panel = panels.panel_a(spark, SF_SMALL)
    sizes = {r["code"]: r["count"] for r in panel.groupBy("code").count().collect()}
    got = {r["code"]: r["n_scored"] for r in by_code.collect()}
    # 2n - 1 rows in all; the first N have no full history of lags.
    assert got == {c: n for c, n in sizes.items() if 2 * n - 1 - n_lags >= n and got.get(c)}
    assert got and forecast.count() > 0
