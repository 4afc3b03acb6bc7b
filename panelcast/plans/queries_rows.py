"""Registered queries: rejected lines, row accounts, ordered selection, whole-frame
fill and order of appearance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelcast.operators import accounting, lag_state, moments, panel as P, scale, series, topk
from panelcast.plans import panels
from panelcast.plans.oracle_sql import with_ctes
from panelcast.plans.queries_panel import (FEATURE_BASE, N_LAGS, RAW_A_SQL, SENTINEL, SENTINEL_DAY, calendar_panel)
from panelcast.plans.registry import ORACLES, register
from panelcast.session import materialize, scratch_path
from panelcast.sources import readers, reject_ledger
from panelcast.sources.readers import RAW_DATE_FORMAT

# Orders whose key is a multiple of these are written with that fault.
NOT_A_NUMBER, COMMA, SHORT_LINE, LONG_LINE, NOT_A_DATE = 97, 89, 83, 79, 73
#: The source's own number of rows in its ordered sample.
SOURCE_TOP_K = 50_000
LOAD = "first"

_LINES_SQL = {
    "o": """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 73 = 0 THEN '13/45/2018'
                   ELSE strftime(CAST(o_orderdate AS DATE), '%-m/%-d/%Y') END AS d,
                   n_name AS s, c_mktsegment AS n, CAST(o_orderdate AS DATE) AS dt,
                   CASE WHEN o_orderkey % 97 = 0 THEN 'abc' WHEN o_orderkey % 89 = 0 THEN '"2,5"'
                        ELSE CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) END AS v,
                   o_orderkey % 83 = 0 AS short, o_orderkey % 79 = 0 AS long
            FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "l": """SELECT *, CASE WHEN short THEN d || ',' || s || ',' || n WHEN long THEN d || ',' || s || ',' || n || ',' || v || ',more'
                      ELSE d || ',' || s || ',' || n || ',' || v END AS line FROM o""",
}


def _written_lines(spark, sf_dir) -> str:
    """The order table as CSV lines, some of them faulty."""
    raw = panels.order_measurements(spark, sf_dir, keep=("o_orderkey",))

    def every(n):
        return F.col("o_orderkey") % n == 0

    date = F.when(every(NOT_A_DATE), F.lit("13/45/2018")).otherwise(F.date_format("time_key", RAW_DATE_FORMAT))
    load = (F.when(every(NOT_A_NUMBER), F.lit("abc")).when(every(COMMA), F.lit('"2,5"'))
            .otherwise(F.round(F.col("ds_load") * 100).cast("long").cast("string")))
    start = F.concat_ws(",", date, "sites", "node_desc")
    line = (F.when(every(SHORT_LINE), start).when(every(LONG_LINE), F.concat_ws(",", start, load, F.lit("more")))
            .otherwise(F.concat_ws(",", start, load)))
    path = scratch_path(spark, "faulty-csv")
    raw.select(line.alias("value")).write.mode("overwrite").text(path)
    return path


def _load(spark, sf_dir) -> reject_ledger.Load:
    return reject_ledger.load_csv(spark, _written_lines(spark, sf_dir), scratch_path(spark, "rejects"), LOAD,
                                  header=False, dates={"time_key": RAW_DATE_FORMAT})


@register("csv_rejected_rows", with_ctes(_LINES_SQL, """
SELECT 'first' AS load, line AS record, CAST(NULL AS VARCHAR) AS "column", 'not a line of 4 fields' AS reason
FROM l WHERE short OR long
UNION ALL SELECT 'first', line, 'ds_load', 'not a double: ' || replace(v, '"', '')
FROM l WHERE NOT short AND NOT long AND (k % 97 = 0 OR k % 89 = 0)
UNION ALL SELECT 'first', line, 'time_key', 'not a date: ' || d
FROM l WHERE NOT short AND NOT long AND k % 73 = 0"""))
def q_csv_rejected_rows(spark, sf_dir):
    """The ledger of a load with faulty numbers, dates and lines."""
    return _load(spark, sf_dir).rejects.select("load", "record", "column", "reason")


@register("csv_rows_with_ledger", with_ctes(_LINES_SQL, """
SELECT dt, s || n AS code, CAST(v AS DOUBLE) AS Y FROM l
WHERE NOT short AND NOT long AND k % 97 <> 0 AND k % 89 <> 0 AND k % 73 <> 0"""))
def q_csv_rows_with_ledger(spark, sf_dir):
    """The lines of the same load that fit, as a panel."""
    rows = _load(spark, sf_dir).rows
    return P.build_panel(rows, date_format=RAW_DATE_FORMAT).select("dt", "code", "Y")


_ACCOUNT_SQL = {
    "r": """SELECT CAST(ts AS DATE) AS dt, CAST(user_id AS VARCHAR) || event_type AS code,
                   CASE WHEN day(ts) % 11 <> 0 THEN value END AS v FROM events""",
    "p": "SELECT code, dt, ROUND(SUM(v), 2) AS y FROM r WHERE dt IS NOT NULL AND code IS NOT NULL AND v IS NOT NULL GROUP BY 1, 2",
    "s": "SELECT code, dt, CASE WHEN day(dt) = 13 THEN -99999999.0 ELSE y END AS y, count(*) OVER (PARTITION BY code) AS n FROM p",
    "w": "SELECT n, " + ", ".join(f"lag(y, {i}) OVER (PARTITION BY code ORDER BY dt) AS y{i}" for i in range(6)) + " FROM s",
    "x": "SELECT y5 IS NULL AS missing, least(y0, y1, y2, y3, y4, y5) < -10000000 AS low FROM w WHERE n >= 7",
}


@register("row_account", with_ctes(_ACCOUNT_SQL, """
SELECT 0 AS step, 'clean' AS name, 'null_date' AS reason, count(*) FILTER (dt IS NULL) AS n_rows FROM r
UNION ALL SELECT 0, 'clean', 'null_key', count(*) FILTER (dt IS NOT NULL AND code IS NULL) FROM r
UNION ALL SELECT 0, 'clean', 'null_load', count(*) FILTER (dt IS NOT NULL AND code IS NOT NULL AND v IS NULL) FROM r
UNION ALL SELECT 0, 'clean', 'kept', count(*) FILTER (dt IS NOT NULL AND code IS NOT NULL AND v IS NOT NULL) FROM r
UNION ALL SELECT 1, 'series', 'short_series', count(*) FILTER (n < 7) FROM s
UNION ALL SELECT 1, 'series', 'kept', count(*) FILTER (n >= 7) FROM s
UNION ALL SELECT 2, 'lags', 'missing_lag', count(*) FILTER (missing) FROM x
UNION ALL SELECT 2, 'lags', 'sentinel', count(*) FILTER (NOT missing AND low) FROM x
UNION ALL SELECT 2, 'lags', 'kept', count(*) FILTER (NOT missing AND NOT low) FROM x"""))
def q_row_account(spark, sf_dir):
    """Rows dropped per cleaning step of the event panel's model frame, counted while it is written."""
    raw = panels.event_measurements(spark, sf_dir).withColumn(
        "ds_load", F.when(F.dayofmonth("time_key") % 11 != 0, F.col("ds_load")))
    account = accounting.RowAccount()
    clean = accounting.clean_measurements(raw, account)
    panel = P.aggregate_panel(P.to_panel(clean), decimals=2)
    coded = panel.withColumn("Y", F.when(F.dayofmonth("dt") == SENTINEL_DAY, F.lit(SENTINEL)).otherwise(F.col("Y")))
    materialize(accounting.model_frame(coded, account, columns=["Y"]), "accounted-frame")
    return account.table(spark)


@register("topk_lines", f"""
SELECT l_extendedprice AS value, l_orderkey, l_linenumber FROM lineitem
ORDER BY value, l_orderkey, l_linenumber LIMIT {SOURCE_TOP_K}""")
def q_topk_lines(spark, sf_dir):
    """The cheapest order lines, as many as the source's own sample keeps."""
    lines = panels.table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("value"), "l_orderkey", "l_linenumber")
    return topk.top_k_rows(lines, SOURCE_TOP_K, ["value", "l_orderkey", "l_linenumber"])


@register("ffill_frame", with_ctes({"panel": panels.PANEL_A_SQL, "gaps": """
SELECT code, dt, CASE WHEN day(dt) % 3 <> 0 AND dt > min(dt) OVER (PARTITION BY code) THEN Y END AS Y FROM panel"""}, """
SELECT code, dt, Y, last_value(Y IGNORE NULLS) OVER (ORDER BY code, dt ROWS UNBOUNDED PRECEDING) AS Y_ffill FROM gaps"""))
def q_ffill_frame(spark, sf_dir):
    """The source's fill over the whole frame: the first value of every series is
    missing here and comes from the end of the series before."""
    panel = panels.panel_a(spark, sf_dir)
    first = F.min("dt").over(Window.partitionBy("code"))
    gaps = panel.withColumn("Y", F.when((F.dayofmonth("dt") % 3 != 0) & (F.col("dt") > first), F.col("Y")))
    return series.forward_fill_frame(gaps, "Y", out="Y_ffill")


@register("codes_in_order", with_ctes({"raw": RAW_A_SQL.replace("o_totalprice AS Y", "o_orderkey AS k")}, """
SELECT code, row_number() OVER (ORDER BY min(k)) - 1 AS place FROM raw GROUP BY code"""))
def q_codes_in_order(spark, sf_dir):
    """Series keys by first appearance in files that hold the orders by rising key."""
    path = scratch_path(spark, "ordered-files")
    raw = panels.raw_orders(spark, sf_dir)
    raw.repartitionByRange("ok").sortWithinPartitions("ok").select("code", "Y").write.parquet(path)
    return P.codes_in_order(readers.read_parquet(spark, path, ordinal=True))


# Rows before this date are a first load, the others an append.
APPEND_FROM = "1997-01-01"


@register("lag_frame_incremental", ORACLES["lag_frame_backward"])
def q_lag_frame_incremental(spark, sf_dir):
    """The lag frame of panel A from two appends; each row is framed when it arrives."""
    panel = materialize(calendar_panel(spark, sf_dir), "calendar-panel")
    first, state = lag_state.append(None, panel.where(F.col("dt") < APPEND_FROM), N_LAGS, FEATURE_BASE)
    then, _ = lag_state.append(state, panel.where(F.col("dt") >= APPEND_FROM))
    return first.unionByName(then)


def _merged_moments(spark, sf_dir):
    panel = materialize(calendar_panel(spark, sf_dir), "calendar-panel")
    path = scratch_path(spark, "moments")
    moments.append_moments(panel.where(F.col("dt") < APPEND_FROM), FEATURE_BASE, path, "first")
    return panel, moments.append_moments(panel.where(F.col("dt") >= APPEND_FROM), FEATURE_BASE, path, "then")


@register("zscore_merged", ORACLES["zscore"])
def q_zscore_merged(spark, sf_dir):
    """Scaling by mean and deviation merged from the daily moments of two loads."""
    panel, table = _merged_moments(spark, sf_dir)
    scaled, _, _ = scale.zscore(panel, FEATURE_BASE, *moments.zscore_statistics(table, FEATURE_BASE))
    return scaled.select("code", "dt", *[F.round(c, 6).alias(c) for c in FEATURE_BASE])


@register("minmax_merged", ORACLES["minmax_shifted"])
def q_minmax_merged(spark, sf_dir):
    """Scaling by the range merged from the same moments."""
    panel, table = _merged_moments(spark, sf_dir)
    scaled, _, _ = scale.minmax_shifted(panel, FEATURE_BASE, *moments.minmax_statistics(table, FEATURE_BASE))
    return scaled.select("code", "dt", *[F.round(c, 9).alias(c) for c in FEATURE_BASE])
