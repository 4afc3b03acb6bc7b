"""Registered queries: sources, cleaning, features, lag frames, split, metrics,
scaling and labels. Panel A (orders by nation||segment and order date) unless
noted; panel B is the event stream by user||event type and day."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.functions.calendar_features import CALENDAR_COLUMNS, add_calendar_features
from panelcast.functions.labels import FAULT_DATE_FORMAT, ROW_DATE_FORMAT, label_rows
from panelcast.operators import lags, metrics, panel as P, scale, series, split
from panelcast.plans import panels
from panelcast.plans.oracle_sql import calendar_select, lag_select, with_ctes
from panelcast.plans.registry import register
from panelcast.session import materialize, scratch_path
from panelcast.sources import readers
from panelcast.sources.readers import RAW_DATE_FORMAT

FEATURE_BASE = ["Y", *CALENDAR_COLUMNS]
N_LAGS = 5
# Fixed value for the equality-filter query: one series key of panel A.
FILTER_CODE = "NATION_7MACHINERY"
# Rows kept by the top-k query (the source's commented sample keeps 50000).
TOP_K_ROWS = 500
# Readings on the 13th of a month are coded with this sentinel (< -1e7).
SENTINEL = -99999999.0
SENTINEL_DAY = 13

PANEL_A = panels.PANEL_A_SQL
CAL_A = calendar_select("panel")
RAW_A_SQL = """
SELECT CAST(o_orderdate AS DATE) AS dt, n_name || c_mktsegment AS code, o_totalprice AS Y
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""


def calendar_panel(spark, sf_dir):
    return add_calendar_features(panels.panel_a(spark, sf_dir))


def lag_frame_a(spark, sf_dir, **kw):
    return lags.lag_frame(calendar_panel(spark, sf_dir), N_LAGS, columns=FEATURE_BASE, **kw)


def model_frame_a(spark, sf_dir):
    """Lag frame -> sentinel filter -> label column ``Y`` (the training table), written once.

    The split bounds are then an aggregate over one column of a table, not a
    second pass over the windows.
    """
    return materialize(lags.label_from_lag0(lags.drop_sentinels(lag_frame_a(spark, sf_dir))), "model-frame")


# ------------------------------------------------------------------ sources
@register("panel_sum", with_ctes({"panel": PANEL_A}, "SELECT code, dt, Y FROM panel"))
def q_panel_sum(spark, sf_dir):
    return panels.panel_a(spark, sf_dir)


@register("panel_sql_view", """
SELECT CAST(o_orderdate AS DATE) AS date,
       CAST(c_nationkey AS VARCHAR) || CASE WHEN c_custkey % 7 = 0 THEN 'null' ELSE c_mktsegment END AS market,
       ROUND(SUM(o_totalprice), 2) AS value
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_totalprice IS NOT NULL
GROUP BY CAST(o_orderdate AS DATE), c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN 'null' ELSE c_mktsegment END
""")
def q_panel_sql_view(spark, sf_dir):
    """Warehouse path: temp view -> SQL clean / cast / coalesce / sum -> market key.

    Every seventh customer has no segment here, so the missing-node text is used.
    """
    orders = panels.table(spark, sf_dir, "orders")
    customer = panels.table(spark, sf_dir, "customer")
    raw = (orders.join(customer, orders.o_custkey == customer.c_custkey)
           .select(F.col("o_orderdate").cast("date").alias("dt"),
                   F.col("c_nationkey").alias("site_id"),
                   F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("node_desc"),
                   F.col("o_totalprice").alias("us_load")))
    view = readers.register_view(raw, "weekly_utilization_node")
    out = readers.warehouse_panel_sql(spark, view)
    return out.select("date", "market", F.round("value", 2).alias("value"))


@register("csv_source", RAW_A_SQL)
def q_csv_source(spark, sf_dir):
    """Write the raw table as CSV with M/d/yyyy dates, read it back, build the panel."""
    raw = panels.order_measurements(spark, sf_dir).withColumn(
        "time_key", F.date_format("time_key", RAW_DATE_FORMAT))
    path = scratch_path(spark, "raw-csv")
    raw.write.mode("overwrite").option("header", True).csv(path)
    back = readers.read_csv(spark, path)
    return P.build_panel(back, date_format=RAW_DATE_FORMAT).select("dt", "code", "Y")


@register("clean_dropna", """
SELECT o_orderdate AS date, n_name || c_mktsegment AS market, o_totalprice AS value
FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN orders ON o_custkey = c_custkey
WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL
""")
def q_clean_dropna(spark, sf_dir):
    """Customers without orders carry null dates and loads; dropna removes them."""
    return P.clean_measurements(panels.customer_measurements(spark, sf_dir))


@register("key_market_table", """
SELECT o_orderdate AS time_key, o_totalprice AS ds_load, n_name || c_mktsegment AS market
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
""")
def q_key_market_table(spark, sf_dir):
    """The raw table through a catalog view, keyed by market with its parts dropped."""
    view = readers.register_view(panels.order_measurements(spark, sf_dir), "raw_measurements")
    return P.key_market(readers.read_table(spark, view))


@register("parquet_source", RAW_A_SQL)
def q_parquet_source(spark, sf_dir):
    """Write the raw table in the default format, load it back, build the panel."""
    path = scratch_path(spark, "raw-parquet")
    panels.order_measurements(spark, sf_dir).write.mode("overwrite").parquet(path)
    return P.build_panel(readers.read_parquet(spark, path)).select("dt", "code", "Y")


@register("filter_code", with_ctes({"panel": PANEL_A},
                                    f"SELECT code, dt, Y FROM panel WHERE code = '{FILTER_CODE}'"))
def q_filter_code(spark, sf_dir):
    return P.filter_code(panels.panel_a(spark, sf_dir), FILTER_CODE)


@register("distinct_codes", with_ctes({"panel": PANEL_A}, "SELECT DISTINCT code FROM panel"))
def q_distinct_codes(spark, sf_dir):
    return P.distinct_codes(panels.panel_a(spark, sf_dir))


@register("topk_value", f"""
SELECT o_orderdate AS date, n_name || c_mktsegment AS market, o_totalprice AS value
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
ORDER BY value, market, date LIMIT {TOP_K_ROWS}
""")
def q_topk_value(spark, sf_dir):
    clean = P.clean_measurements(panels.order_measurements(spark, sf_dir))
    return P.top_k_rows(clean, TOP_K_ROWS, ["value", "market", "date"])


# ------------------------------------------------------------------ series
_SPINE_SQL = {
    "panel": PANEL_A,
    "b": "SELECT code, min(dt) AS lo, max(dt) AS hi FROM panel GROUP BY code",
    "g": "SELECT code, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS dt FROM b",
    "f": "SELECT g.code, g.dt, p.Y FROM g LEFT JOIN panel p ON g.code = p.code AND g.dt = p.dt",
}


@register("ffill_series", with_ctes(_SPINE_SQL, """
SELECT code, dt, Y,
       last_value(Y IGNORE NULLS) OVER (PARTITION BY code ORDER BY dt
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS Y_ffill
FROM f"""))
def q_ffill_series(spark, sf_dir):
    """Daily grid per series (gap days missing), forward-filled within each code."""
    dense = series.daily_spine(panels.panel_a(spark, sf_dir))
    return series.forward_fill(dense, "Y", out="Y_ffill")


@register("ffill_series_balanced", with_ctes(_SPINE_SQL, """
SELECT code, dt, Y,
       last_value(Y IGNORE NULLS) OVER (PARTITION BY code ORDER BY dt
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS Y_ffill
FROM f"""))
def q_ffill_series_balanced(spark, sf_dir):
    """The same fill by pieces of a series."""
    dense = series.daily_spine(panels.panel_a(spark, sf_dir))
    return series.forward_fill(dense, "Y", out="Y_ffill", strategy="balanced")


@register("calendar_features", with_ctes({"panel": PANEL_A}, CAL_A))
def q_calendar_features(spark, sf_dir):
    return calendar_panel(spark, sf_dir)


_LAG_A, LAG_NAMES = lag_select("cal", FEATURE_BASE, N_LAGS)
_LAG_A_KEEP, _ = lag_select("cal", FEATURE_BASE, N_LAGS, drop_null=False)
_LEAD_A, _ = lag_select("cal", FEATURE_BASE, N_LAGS, mode="forward")
_CTE_CAL_A = {"panel": PANEL_A, "cal": CAL_A}


@register("lag_frame_backward", with_ctes(_CTE_CAL_A, _LAG_A))
def q_lag_frame_backward(spark, sf_dir):
    return lag_frame_a(spark, sf_dir)


@register("lag_frame_keep_null", with_ctes(_CTE_CAL_A, _LAG_A_KEEP))
def q_lag_frame_keep_null(spark, sf_dir):
    return lag_frame_a(spark, sf_dir, drop_null=False)


@register("lead_frame_forward", with_ctes(_CTE_CAL_A, _LEAD_A))
def q_lead_frame_forward(spark, sf_dir):
    return lag_frame_a(spark, sf_dir, mode="forward")


_RAW_LAG_CTE = {
    "raw": ("SELECT n_name || c_mktsegment AS code, CAST(o_orderdate AS DATE) AS dt, "
            "o_totalprice AS Y, o_orderkey AS ok FROM orders "
            "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"),
    "cal": calendar_select("raw", "code, dt, Y, ok"),
}
_RAW_LAG, _ = lag_select("cal", FEATURE_BASE, N_LAGS, order="dt, ok")


@register("lag_frame_raw_balanced", with_ctes(_RAW_LAG_CTE, _RAW_LAG))
def q_lag_frame_raw_balanced(spark, sf_dir):
    """Lag frame over un-aggregated order rows (ties ordered by order key),
    computed with the balanced strategy: no series is held by one task."""
    raw = panels.raw_orders(spark, sf_dir)
    return lags.lag_frame(add_calendar_features(raw), N_LAGS, columns=FEATURE_BASE,
                          order=("dt", "ok"), strategy="balanced")


_LAG_B, _ = lag_select("cal", FEATURE_BASE, N_LAGS)


@register("short_series_filter",
          with_ctes({"panel": panels.PANEL_B_SQL, "cal": CAL_A}, _LAG_B))
def q_short_series_filter(spark, sf_dir):
    """Panel B has many series shorter than N + 2 rows; they yield no lag rows."""
    cal = add_calendar_features(panels.panel_b(spark, sf_dir))
    return lags.lag_frame(cal, N_LAGS, columns=FEATURE_BASE)


@register("short_series_only", with_ctes({"panel": panels.PANEL_B_SQL}, """
SELECT code, dt, Y FROM (SELECT *, count(*) OVER (PARTITION BY code) AS n FROM panel) WHERE n >= 12"""))
def q_short_series_only(spark, sf_dir):
    """The series of panel B with at least ten lags to spare, by a keyed aggregate."""
    return lags.short_series_filter(panels.panel_b(spark, sf_dir), 10, strategy="balanced")


_CODED_CTE = {
    "panel": PANEL_A,
    "s": f"SELECT code, dt, CASE WHEN day(dt) = {SENTINEL_DAY} THEN {SENTINEL} ELSE Y END AS Y FROM panel",
    "cal": calendar_select("s"),
}
_CODED_LAG, _ = lag_select("cal", FEATURE_BASE, N_LAGS)
_CODED_CTE["lagged"] = _CODED_LAG
_OUTLIER_KEEP = " AND ".join(f"{c} >= -10000000.0" for c in LAG_NAMES)


@register("outlier_filter", with_ctes(_CODED_CTE, f"""
SELECT code, dt, Y_000_day_before AS Y, Y_001_day_before, Y_005_day_before, days2_005_day_before
FROM lagged WHERE {_OUTLIER_KEEP}"""))
def q_outlier_filter(spark, sf_dir):
    """Some readings are coded as missing; lag rows that touch one are dropped."""
    panel = panels.panel_a(spark, sf_dir)
    coded = panel.withColumn("Y", F.when(F.dayofmonth("dt") == SENTINEL_DAY, F.lit(SENTINEL))
                             .otherwise(F.col("Y")))
    framed = lags.lag_frame(add_calendar_features(coded), N_LAGS, columns=FEATURE_BASE)
    kept = lags.label_from_lag0(lags.drop_sentinels(framed))
    return kept.select("code", "dt", "Y", "Y_001_day_before", "Y_005_day_before",
                       "days2_005_day_before")


# ------------------------------------------------------------------ split
_MODEL_COLS = ["Y" if c == "Y_000_day_before" else c for c in LAG_NAMES]
_MODEL_SELECT = ", ".join(
    "Y_000_day_before AS Y" if c == "Y_000_day_before" else c for c in LAG_NAMES)
_SPLIT_CTE = dict(_CTE_CAL_A)
_SPLIT_CTE["lagged"] = _LAG_A
_SPLIT_CTE["model"] = (f"SELECT code, dt, {_MODEL_SELECT} FROM lagged WHERE "
                       + " AND ".join(f"{c} >= -10000000.0" for c in LAG_NAMES))
_SPLIT_CTE["bounds"] = ("SELECT min(dt) + CAST(floor(date_diff('day', min(dt), max(dt)) * 0.75) "
                        "AS INTEGER) AS train_end FROM model")
_SPLIT_CTE["marked"] = ("SELECT model.*, dt <= train_end AS is_train "
                        "FROM model CROSS JOIN bounds")


@register("time_split_train", with_ctes(
    _SPLIT_CTE, f"SELECT code, dt, {', '.join(_MODEL_COLS)} FROM marked WHERE is_train"))
def q_time_split_train(spark, sf_dir):
    return split.time_split(model_frame_a(spark, sf_dir))[0]


@register("time_split_test", with_ctes(
    _SPLIT_CTE, f"SELECT code, dt, {', '.join(_MODEL_COLS)} FROM marked WHERE NOT is_train"))
def q_time_split_test(spark, sf_dir):
    return split.time_split(model_frame_a(spark, sf_dir))[1]


# ------------------------------------------------------------------ metrics
def _naive_split_frame(spark, sf_dir):
    marked = split.mark_split(model_frame_a(spark, sf_dir))
    return marked.select(
        "code", "Y", F.col("Y_001_day_before").alias("prediction"),
        F.when(F.col("is_train"), F.lit("train")).otherwise(F.lit("test")).alias("split"))


@register("mape_by_split", with_ctes(_SPLIT_CTE, """
SELECT CASE WHEN is_train THEN 'train' ELSE 'test' END AS split,
       ROUND(avg(abs((Y_001_day_before - Y) / nullif(Y, 0))), 9) AS mape,
       count(abs((Y_001_day_before - Y) / nullif(Y, 0))) AS n_scored,
       CAST(sum(CASE WHEN Y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero_truth
FROM marked GROUP BY 1"""))
def q_mape_by_split(spark, sf_dir):
    """Naive lag-1 prediction scored with MAPE on train and test."""
    return metrics.mape(_naive_split_frame(spark, sf_dir), by=["split"], decimals=9)


@register("rmse_by_split", with_ctes(_SPLIT_CTE, """
SELECT CASE WHEN is_train THEN 'train' ELSE 'test' END AS split,
       ROUND(sqrt(avg(pow(Y_001_day_before - Y, 2))), 4) AS rmse,
       count(Y_001_day_before - Y) AS n_scored
FROM marked GROUP BY 1"""))
def q_rmse_by_split(spark, sf_dir):
    return metrics.rmse(_naive_split_frame(spark, sf_dir), by=["split"], decimals=4)


@register("mape_by_code", with_ctes(_SPLIT_CTE, """
SELECT code, ROUND(avg(abs((Y_001_day_before - Y) / nullif(Y, 0))), 9) AS mape,
       count(abs((Y_001_day_before - Y) / nullif(Y, 0))) AS n_scored,
       CAST(sum(CASE WHEN Y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero_truth
FROM model GROUP BY code"""))
def q_mape_by_code(spark, sf_dir):
    frame = lags.label_from_lag0(lags.drop_sentinels(lag_frame_a(spark, sf_dir))).select(
        "code", "Y", F.col("Y_001_day_before").alias("prediction"))
    return metrics.mape(frame, by=["code"], decimals=9)


# ------------------------------------------------------------------ scaling
def _stat_select(expr_fmt: str, decimals: int) -> str:
    cols = ", ".join(f"ROUND({expr_fmt.format(c=c)}, {decimals}) AS {c}" for c in FEATURE_BASE)
    return f"SELECT code, dt, {cols} FROM cal"


@register("zscore", with_ctes(_CTE_CAL_A, _stat_select(
    "({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0)", 6)))
def q_zscore(spark, sf_dir):
    scaled, _, _ = scale.zscore(calendar_panel(spark, sf_dir), FEATURE_BASE)
    return scaled.select("code", "dt", *[F.round(c, 6).alias(c) for c in FEATURE_BASE])


@register("minmax_shifted", with_ctes(_CTE_CAL_A, _stat_select(
    "({c} - (min({c}) OVER () + 0.001)) / nullif(max({c}) OVER () - (min({c}) OVER () + 0.001), 0)",
    9)))
def q_minmax_shifted(spark, sf_dir):
    scaled, _, _ = scale.minmax_shifted(calendar_panel(spark, sf_dir), FEATURE_BASE)
    return scaled.select("code", "dt", *[F.round(c, 9).alias(c) for c in FEATURE_BASE])


_RANGE_CTE = {
    "panel": PANEL_A,
    "mm": ("SELECT code, dt, Y, min(Y) OVER (PARTITION BY code) AS xmin, "
           "max(Y) OVER (PARTITION BY code) AS xmax FROM panel"),
    "sc": ("SELECT code, dt, Y, xmin, xmax, "
           "CAST(2930 AS DOUBLE) * (Y - xmin) / nullif(xmax - xmin, 0) + CAST(70 AS DOUBLE) "
           "AS Y_scaled FROM mm"),
}


@register("range_scale_by_code", with_ctes(_RANGE_CTE, "SELECT * FROM sc"))
def q_range_scale_by_code(spark, sf_dir):
    return scale.range_scale_by_code(panels.panel_a(spark, sf_dir)).select(
        "code", "dt", "Y", "xmin", "xmax", "Y_scaled")


@register("range_scale_by_code_keyed", with_ctes(_RANGE_CTE, "SELECT * FROM sc"))
def q_range_scale_by_code_keyed(spark, sf_dir):
    """The same scaling from a keyed aggregate joined back (no per-series window)."""
    return scale.range_scale_by_code(panels.panel_a(spark, sf_dir), strategy="balanced").select(
        "code", "dt", "Y", "xmin", "xmax", "Y_scaled")


@register("range_unscale_by_code", with_ctes(_RANGE_CTE, """
SELECT code, dt, (xmax - xmin) * (pred - CAST(70 AS DOUBLE)) / CAST(2930 AS DOUBLE) + xmin
       AS unscale_pred
FROM (SELECT code, dt, xmin, xmax,
             lag(Y_scaled) OVER (PARTITION BY code ORDER BY dt) AS pred FROM sc)
WHERE pred IS NOT NULL"""))
def q_range_unscale_by_code(spark, sf_dir):
    """Scaled naive lag-1 prediction mapped back to the original units."""
    s = scale.range_scale_by_code(panels.panel_a(spark, sf_dir))
    pred = F.lag("Y_scaled").over(lags.series_window())
    s = s.withColumn("pred", pred).where(F.col("pred").isNotNull())
    return s.select("code", "dt", scale.range_unscale(
        F.col("pred"), F.col("xmin"), F.col("xmax")).alias("unscale_pred"))


# ------------------------------------------------------------------ labels
_LABEL_CTE = {
    "panel": PANEL_A,
    "mx": "SELECT code, dt, Y, max(Y) OVER (PARTITION BY code) AS my FROM panel",
    "faults": ("SELECT code, strftime(max(dt), '%Y-%m-%d') AS fault_date "
               "FROM mx WHERE Y = my GROUP BY code"),
    "d": ("SELECT p.code, p.dt, "
          "CAST(strptime(f.fault_date, '%Y-%m-%d') AS DATE) - "
          "CAST(strptime(strftime(p.dt, '%Y%m%d'), '%Y%m%d') AS DATE) AS d "
          "FROM panel p LEFT JOIN faults f ON p.code = f.code"),
}


def faults_fixture(panel):
    """Fault dictionary: per series, the date of its largest value (latest on ties)."""
    return (panel.groupBy("code")
            .agg(F.max_by("dt", F.struct("Y", "dt")).alias("fault_dt"))
            .select("code", F.date_format("fault_dt", FAULT_DATE_FORMAT).alias("fault_date")))


def _labelled(spark, sf_dir, rule):
    panel = panels.panel_a(spark, sf_dir)
    rows = panel.select("code", "dt", F.date_format("dt", ROW_DATE_FORMAT).alias("dt_key"))
    out = label_rows(rows, faults_fixture(panel), rule=rule, dt="dt_key",
                     dt_format=ROW_DATE_FORMAT, fault_format=FAULT_DATE_FORMAT)
    return out.select("code", "dt", "label")


@register("label_within_30d", with_ctes(_LABEL_CTE, """
SELECT code, dt, CASE WHEN d > 0 AND d <= 30 THEN 1 ELSE 0 END AS label FROM d"""))
def q_label_within_30d(spark, sf_dir):
    return _labelled(spark, sf_dir, "intent")


@register("label_within_30d_literal", with_ctes(_LABEL_CTE, """
SELECT code, dt, CASE WHEN d <= (30 & d) AND (30 & d) > 0 THEN 1 ELSE 0 END AS label FROM d"""))
def q_label_within_30d_literal(spark, sf_dir):
    return _labelled(spark, sf_dir, "literal")
