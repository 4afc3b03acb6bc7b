"""Registered queries: growth ratios, extrapolation, history + forecast frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.functions.calendar_features import CALENDAR_COLUMNS, add_calendar_features
from panelcast.operators import extrapolate as X
from panelcast.operators import forecast as FC
from panelcast.operators import lags
from panelcast.plans import panels
from panelcast.plans.oracle_sql import calendar_select, lag_select, with_ctes
from panelcast.plans.registry import register

FEATURE_BASE = ["Y", *CALENDAR_COLUMNS]
N_LAGS = 5
CYCLIC_HORIZON = X.HORIZON_DAYS
LOG_DECIMALS = 6

_W = "PARTITION BY code ORDER BY dt"
_ALL = f"({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"

def state_cte(panel_sql: str, order: str = "dt") -> dict[str, str]:
    """DuckDB CTEs for the series state over ``panel_sql`` ordered by ``order``."""
    w = f"PARTITION BY code ORDER BY {order}"
    wall = f"({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return {
        "panel": panel_sql,
        "mm": ("SELECT *, min(Y) OVER (PARTITION BY code) AS xmin, "
               "max(Y) OVER (PARTITION BY code) AS xmax FROM panel"),
        "sc": ("SELECT * EXCLUDE (Y), "
               "CAST(2930 AS DOUBLE) * (Y - xmin) / nullif(xmax - xmin, 0) + CAST(70 AS DOUBLE) "
               "AS Y FROM mm"),
        "rr": f"SELECT *, Y / nullif(lag(Y) OVER ({w}), 0) AS ratio_raw FROM sc",
        "r": ("SELECT *, CASE WHEN ratio_raw < 0.5 OR ratio_raw > 5 THEN CAST(1 AS DOUBLE) "
              "ELSE ratio_raw END AS ratio FROM rr"),
        "st": (f"SELECT *, row_number() OVER ({w}) AS rn, count(*) OVER (PARTITION BY code) AS n, "
               f"max(dt) OVER (PARTITION BY code) AS last_dt, last_value(Y) OVER {wall} AS last_y, "
               f"coalesce(sum(ln(ratio)) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
               "0) AS ln_prefix FROM r"),
        "fc": ("SELECT code, CAST(rn - 1 AS INTEGER) AS k, "
               "CAST(last_dt + CAST(rn - 1 AS INTEGER) AS DATE) AS dt, "
               "ln(last_y) + ln_prefix AS log_y, n, xmin, xmax FROM st "
               "WHERE rn >= 2 AND rn - 1 <= 3651 AND ratio IS NOT NULL AND last_y IS NOT NULL"),
    }


STATE_CTE = state_cte(panels.PANEL_A_SQL)


def _state(spark, sf_dir):
    return X.scaled_series(panels.panel_a(spark, sf_dir))


@register("step_ratio_smoothed", with_ctes(
    STATE_CTE, "SELECT code, dt, Y, ratio_raw, ratio FROM st"))
def q_step_ratio_smoothed(spark, sf_dir):
    return _state(spark, sf_dir).select("code", "dt", "Y", "ratio_raw", "ratio")


@register("ratio_extrapolate", with_ctes(
    STATE_CTE, f"SELECT code, k, dt, ROUND(log_y, {LOG_DECIMALS}) AS log_y FROM fc"))
def q_ratio_extrapolate(spark, sf_dir):
    fc = X.forecast_from_state(_state(spark, sf_dir))
    return fc.select("code", "k", "dt", F.round("log_y", LOG_DECIMALS).alias("log_y"))


_CYC = dict(STATE_CTE)
_CYC["cy"] = (f"SELECT *, last_value(ln_prefix) OVER {_ALL} AS ln_cycle, "
              "bool_and(rn = 1 OR ratio IS NOT NULL) OVER (PARTITION BY code) AS ok FROM st")
_CYC["ex"] = ("SELECT code, rn - 1 AS m, n, last_dt, last_y, ln_prefix, ln_cycle, "
              "unnest(generate_series(CASE WHEN rn = 1 THEN 1 ELSE 0 END, "
              f"CAST(floor(({CYCLIC_HORIZON} - (rn - 1)) / n) AS BIGINT))) AS q "
              "FROM cy WHERE ok AND last_y IS NOT NULL")


@register("ratio_extrapolate_cyclic", with_ctes(_CYC, f"""
SELECT code, CAST(m + q * n AS INTEGER) AS k,
       CAST(last_dt + CAST(m + q * n AS INTEGER) AS DATE) AS dt,
       ROUND(ln(last_y) + q * ln_cycle + ln_prefix, {LOG_DECIMALS}) AS log_y
FROM ex"""))
def q_ratio_extrapolate_cyclic(spark, sf_dir):
    fc = X.cyclic_forecast_from_state(_state(spark, sf_dir), CYCLIC_HORIZON)
    return fc.select("code", "k", "dt", F.round("log_y", LOG_DECIMALS).alias("log_y"))


_COMB = dict(STATE_CTE)
_COMB["comb"] = ("SELECT code, dt, Y, n AS n_hist FROM st UNION ALL "
                 "SELECT code, dt, exp(log_y) AS Y, n AS n_hist FROM fc")
_COMB["cal"] = calendar_select("comb", "code, dt, Y")
_LAG_COMB, COMB_NAMES = lag_select("cal", FEATURE_BASE, N_LAGS)
_COMB["lagged"] = _LAG_COMB


def _log_projection(names):
    out = []
    for c in names:
        if c.startswith("Y_"):
            out.append((c, f"log_{c}"))
    return out


_Y_LAGS = _log_projection(COMB_NAMES)
_CAL_LAGS = [c for c in COMB_NAMES if not c.startswith("Y_")]


@register("history_plus_forecast_features", with_ctes(_COMB, "SELECT code, dt, "
          + ", ".join(_CAL_LAGS) + ", "
          + ", ".join(f"ROUND(ln({c}), {LOG_DECIMALS}) AS {alias}" for c, alias in _Y_LAGS)
          + " FROM lagged"))
def q_history_plus_forecast_features(spark, sf_dir):
    """Scaled history + literal forecast -> calendar -> lag frame (Y lags in logs)."""
    feats = history_plus_forecast(spark, sf_dir)
    return feats.select("code", "dt", *_CAL_LAGS, *[
        F.round(F.log(c), LOG_DECIMALS).alias(alias) for c, alias in _Y_LAGS])


def history_plus_forecast(spark, sf_dir):
    """Lag frame over scaled history + forecast of panel A (the flagship frame)."""
    combined = add_calendar_features(FC.history_and_forecast(panels.panel_a(spark, sf_dir)))
    return lags.lag_frame(combined, N_LAGS, columns=FEATURE_BASE, order=FC.COMBINED_ORDER)


_POS = dict(_COMB)
_POS["pos"] = (f"SELECT code, Y_001_day_before AS pred, Y_005_day_before AS truth, n_hist, "
               f"row_number() OVER ({_W}) AS i, count(*) OVER (PARTITION BY code) AS n_rows "
               "FROM (SELECT l.*, h.n_hist FROM lagged l JOIN "
               "(SELECT DISTINCT code, n_hist FROM comb) h ON l.code = h.code)")


@register("mape_by_code_positional", with_ctes(_POS, f"""
SELECT code, ROUND(avg(abs((pred - truth) / nullif(truth, 0))), {LOG_DECIMALS}) AS mape,
       count(abs((pred - truth) / nullif(truth, 0))) AS n_scored,
       CAST(sum(CASE WHEN truth = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero_truth
FROM pos WHERE n_rows >= n_hist AND i <= n_hist GROUP BY code"""))
def q_mape_by_code_positional(spark, sf_dir):
    """Per-series MAPE pairing history row i with scored row i (naive lag-1 model)."""
    feats = FC.forecast_features(panels.panel_a(spark, sf_dir), N_LAGS)
    scored = feats.withColumn("prediction", F.col("Y_001_day_before"))
    out = FC.positional_mape(scored, "prediction", N_LAGS)
    return out.select("code", F.round("mape", LOG_DECIMALS).alias("mape"), "n_scored", "n_zero_truth")


_RAW_STATE = state_cte(
    "SELECT n_name || c_mktsegment AS code, CAST(o_orderdate AS DATE) AS dt, "
    "o_totalprice AS Y, o_orderkey AS ok FROM orders "
    "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    order="dt, ok")


@register("ratio_extrapolate_raw_balanced", with_ctes(
    _RAW_STATE, f"SELECT code, k, dt, ROUND(log_y, {LOG_DECIMALS}) AS log_y FROM fc"))
def q_ratio_extrapolate_raw_balanced(spark, sf_dir):
    """Literal extrapolation of un-aggregated order rows (ties by order key),
    with the balanced series state: no series is held by one task."""
    raw = panels.raw_orders(spark, sf_dir)
    state = X.scaled_series(raw, order=("dt", "ok"), strategy="balanced")
    fc = X.forecast_from_state(state)
    return fc.select("code", "k", "dt", F.round("log_y", LOG_DECIMALS).alias("log_y"))
