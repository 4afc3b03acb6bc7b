"""Per-series growth-ratio extrapolation, for every series in one plan.

For a series scaled to [70, 3000] the step ratios ``r_i = s_i / s_{i-1}``
are smoothed (ratios below 0.5 or above 5 become 1) and replayed onto the
last value: ``v_k = v_{k-1} * r[k mod n]``, one value per day after the last
date.

* ``ratio_forecast`` follows the source literally. ``r[0]`` is missing (there
  is no previous value), so the product turns missing at ``k = n`` and the
  usable horizon is ``min(horizon, n - 1)``: forecast ``k`` uses history rows
  ``1..k`` and is emitted by history row ``k``.
* ``ratio_forecast_cyclic`` is the evident intent: ``r[0]`` is taken as 1 and
  the cycle repeats, ``v_k = last * P^(k div n) * prefix[k mod n]`` with
  ``P`` the product over one cycle. History row ``m`` emits every ``k`` with
  ``k mod n = m``.

Both run in log space (the clamps are asymmetric, so products overflow on
noisy series) and in the single code-partitioned window pass that also
computes the ratios: no driver loop, no join, one shuffle on ``code``. The
output per series is bounded by ``horizon``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.lags import series_window, whole_series
from panelcast.operators.scale import range_scale
from panelcast.operators.slices import (
    PIECE, all_pieces, check_strategy, earlier_pieces, range_slices, with_halo,
)
from panelcast.session import materialize

# Smoothing clamps and the forecast horizon (ten years of days,
# both ends of the date range included).
RATIO_LOW = 0.5
RATIO_HIGH = 5.0
HORIZON_DAYS = 3651


def smooth_ratio(r: Column, low: float = RATIO_LOW, high: float = RATIO_HIGH) -> Column:
    """Ratios outside [low, high] become 1; a missing ratio stays missing."""
    return F.when((r < low) | (r > high), F.lit(1.0)).otherwise(r)


def step_ratios(df: DataFrame, col: str = "Y", key: str = "code",
                order: tuple[str, ...] = ("dt",)) -> DataFrame:
    """Adds ``ratio_raw = col / previous col`` and its smoothed ``ratio``."""
    w = series_window(key, order)
    raw = F.try_divide(F.col(col), F.lag(col, 1).over(w))
    return (df.withColumn("ratio_raw", raw)
              .withColumn("ratio", smooth_ratio(F.col("ratio_raw"))))


def scaled_series(panel: DataFrame, col: str = "Y", key: str = "code",
                  order: tuple[str, ...] = ("dt",), scale: bool = True,
                  strategy: str = "window") -> DataFrame:
    """Series state used by both forecasts, all from one window specification.

    Columns: key, dt, Y (the scaled value when ``scale``), xmin, xmax, rn, n,
    last_dt, last_y, ratio_raw, ratio, ln_prefix (sum of log ratios of rows
    2..rn; 0 for row 1). ``strategy="balanced"`` computes the same state
    without any per-series task (for un-aggregated input with a hot series).
    """
    check_strategy(strategy)
    if strategy == "balanced":
        return _scaled_series_balanced(panel, col, key, order, scale)
    w = series_window(key, order)
    wall = whole_series(key, order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = (panel.select(key, "dt", *[c for c in order if c != "dt"], F.col(col).alias("_raw"))
          .withColumn("xmin", F.min("_raw").over(wall))
          .withColumn("xmax", F.max("_raw").over(wall)))
    y = range_scale(F.col("_raw"), F.col("xmin"), F.col("xmax")) if scale else F.col("_raw")
    df = df.withColumn("Y", y)
    df = step_ratios(df, "Y", key, order)
    return (df.withColumn("rn", F.row_number().over(w))
              .withColumn("n", F.count(F.lit(1)).over(wall))
              .withColumn("last_dt", F.last("dt").over(wall))
              .withColumn("last_y", F.last("Y").over(wall))
              .withColumn("ln_prefix",
                          F.coalesce(F.sum(F.log(F.col("ratio"))).over(run), F.lit(0.0))))


CARRY = ("n", "xmin", "xmax")

FORECAST_ROW = T.StructType([
    T.StructField("k", T.IntegerType()),
    T.StructField("dt", T.DateType()),
    T.StructField("log_y", T.DoubleType()),
    T.StructField("sign", T.DoubleType()),
])


def _no_rows() -> Column:
    return F.array().cast(T.ArrayType(FORECAST_ROW))


def _scaled_series_balanced(panel: DataFrame, col: str, key: str,
                            order: tuple[str, ...], scale: bool) -> DataFrame:
    """The series state of :func:`scaled_series` from slices of the global order.

    Series statistics come from the table of pieces; the previous value
    from a halo of one row; the log-ratio prefix is a running sum inside the
    piece plus the sums of earlier pieces. The cycle columns, two more sums
    over pieces, are included.
    """
    extra = [c for c in order if c != "dt"]
    sl = range_slices(
        panel.select(key, "dt", *extra, F.col(col).alias("_raw")), key, order, aggregates=(
            F.min("_raw").alias("_lo"), F.max("_raw").alias("_hi"),
            F.max_by(F.struct("dt", "_raw"), F.struct(*order)).alias("_end")))
    whole = all_pieces()
    stats = sl.pieces.select(*PIECE, "_off", F.col("_n").alias("n"),
                             F.min("_lo").over(whole).alias("xmin"),
                             F.max("_hi").over(whole).alias("xmax"),
                             F.last("_end").over(whole).alias("_end"))
    df = with_halo(sl, 1).join(stats, PIECE)
    lo, hi = F.col("xmin"), F.col("xmax")

    def scaled(x: Column) -> Column:
        return range_scale(x, lo, hi) if scale else x

    df = (df.withColumn("Y", scaled(F.col("_raw"))).withColumn("last_y", scaled(F.col("_end._raw")))
          .withColumn("last_dt", F.col("_end.dt")))
    w, run = sl.window(), sl.running()
    own = F.when(F.col("_halo"), 0).otherwise(1)
    df = df.withColumn("ratio_raw", F.try_divide(F.col("Y"), F.lag("Y", 1).over(w)))
    df = df.withColumn("ratio", smooth_ratio(F.col("ratio_raw")))
    df = (df.withColumn("rn", (F.col("_off") + F.sum(own).over(run)))
          .withColumn("_in", F.sum(F.log("ratio")).over(run)).where(~F.col("_halo")))
    # The sums per piece and the result both read the state: it is written once.
    df = materialize(df, "series-state")
    sums = df.groupBy(*PIECE).agg(
        F.sum(F.log("ratio")).alias("_s"),
        F.min((F.col("rn") == 1) | F.col("ratio").isNotNull()).alias("_ok"))
    sums = sums.select(*PIECE, F.sum("_s").over(earlier_pieces()).alias("_before"),
                       F.coalesce(F.sum("_s").over(whole), F.lit(0.0)).alias("ln_cycle"),
                       F.min("_ok").over(whole).alias("cycle_ok"))
    return (df.join(sums, PIECE)
            .withColumn("ln_prefix", F.coalesce("_before", F.lit(0.0)) + F.coalesce("_in", F.lit(0.0)))
            .drop(*PIECE, "_off", "_end", "_halo", "_in", "_before"))


def with_cycle(s: DataFrame, key: str = "code", order: tuple[str, ...] = ("dt",)) -> DataFrame:
    """Adds the cycle's log product and whether every ratio of the cycle exists."""
    if "ln_cycle" in s.columns and "cycle_ok" in s.columns:
        return s
    wall = whole_series(key, order)
    ok = F.min(F.when(F.col("rn") == 1, F.lit(True))
               .otherwise(F.col("ratio").isNotNull())).over(wall)
    return (s.withColumn("ln_cycle", F.last("ln_prefix").over(wall))
             .withColumn("cycle_ok", ok))


def forecast_rows(horizon: int = HORIZON_DAYS, cyclic: bool = False) -> Column:
    """Per history row: the forecast rows it emits, ``array<struct<k, dt, log_y>>``.

    Literal: row ``rn`` emits ``k = rn - 1`` (rows 2..min(horizon+1, n)).
    Cyclic (needs :func:`with_cycle`): row ``rn`` (``m = rn - 1``) emits every
    ``k = m + q n`` in 1..horizon.
    """
    # The product is taken in logs of the magnitude; the last value gives the sign.
    last, sign = F.log(F.abs("last_y")), F.signum("last_y").alias("sign")
    if not cyclic:
        k = (F.col("rn") - 1).cast(T.IntegerType())
        valid = ((F.col("rn") >= 2) & (k <= horizon) & F.col("ratio").isNotNull()
                 & F.col("last_y").isNotNull())
        one = F.struct(k.alias("k"), F.date_add("last_dt", k).alias("dt"),
                       (last + F.col("ln_prefix")).alias("log_y"), sign)
        return F.when(valid, F.array(one)).otherwise(_no_rows())
    m = F.col("rn") - 1
    q_lo = F.when(m == 0, F.lit(1)).otherwise(F.lit(0))
    q_hi = F.floor((F.lit(horizon) - m) / F.col("n")).cast(T.IntegerType())
    qs = F.when(q_hi >= q_lo, F.sequence(q_lo, q_hi)).otherwise(
        F.array().cast(T.ArrayType(T.IntegerType())))

    def row(q):
        k = (m + q * F.col("n")).cast(T.IntegerType())
        return F.struct(k.alias("k"), F.date_add("last_dt", k).alias("dt"),
                        (last + q * F.col("ln_cycle") + F.col("ln_prefix")).alias("log_y"), sign)

    valid = F.col("cycle_ok") & F.col("last_y").isNotNull()
    return F.when(valid, F.transform(qs, row)).otherwise(_no_rows())


def _value(f: Column) -> Column:
    return F.when(f["sign"] == 0, F.lit(0.0)).otherwise(f["sign"] * F.exp(f["log_y"]))


def _explode_forecast(s: DataFrame, rows: Column, key: str) -> DataFrame:
    f = s.select(key, *CARRY, F.explode(rows).alias("f"))
    return f.select(key, "f.k", "f.dt", "f.log_y", *CARRY, _value(F.col("f")).alias("Y"))


def ratio_forecast(panel: DataFrame, horizon: int = HORIZON_DAYS, col: str = "Y",
                   key: str = "code", order: tuple[str, ...] = ("dt",),
                   scale: bool = True) -> DataFrame:
    """Literal replay: ``(code, k, dt, log_y, n, xmin, xmax, Y)``, ``k = 1..min(horizon, n-1)``."""
    return forecast_from_state(scaled_series(panel, col, key, order, scale), horizon, key)


def ratio_forecast_cyclic(panel: DataFrame, horizon: int = HORIZON_DAYS, col: str = "Y",
                          key: str = "code", order: tuple[str, ...] = ("dt",),
                          scale: bool = True) -> DataFrame:
    """Cyclic replay with ``r[0] = 1`` for ``k = 1..horizon``."""
    return cyclic_forecast_from_state(scaled_series(panel, col, key, order, scale),
                                      horizon, key, order)


def forecast_from_state(s: DataFrame, horizon: int = HORIZON_DAYS, key: str = "code") -> DataFrame:
    return _explode_forecast(s, forecast_rows(horizon), key)


def cyclic_forecast_from_state(s: DataFrame, horizon: int = HORIZON_DAYS, key: str = "code",
                               order: tuple[str, ...] = ("dt",)) -> DataFrame:
    return _explode_forecast(with_cycle(s, key, order), forecast_rows(horizon, True), key)


def history_with_forecast(s: DataFrame, horizon: int = HORIZON_DAYS, cyclic: bool = False,
                          key: str = "code", order: tuple[str, ...] = ("dt",)) -> DataFrame:
    """Each history row followed by the forecast rows it emits, in one pass.

    Output ``(key, dt, Y, n_hist, xmin, xmax, is_forecast, seq)``; ``seq`` is
    the row's place in the combined series (history position, then ``n + k``)
    so ties on ``dt`` in raw history keep their order downstream. The
    explode keeps the state's partitioning by ``key``, so a following
    per-series window needs no further exchange.
    """
    if cyclic:
        s = with_cycle(s, key, order)
    hist = F.array(F.struct(F.col("dt").alias("dt"), F.col("Y").alias("Y"),
                            F.lit(False).alias("is_forecast"),
                            F.col("rn").cast(T.LongType()).alias("seq")))
    fc = F.transform(forecast_rows(horizon, cyclic),
                     lambda f: F.struct(f["dt"].alias("dt"), _value(f).alias("Y"),
                                        F.lit(True).alias("is_forecast"),
                                        (F.col("n") + f["k"]).cast(T.LongType()).alias("seq")))
    out = s.select(key, F.col("n").alias("n_hist"), "xmin", "xmax",
                   F.explode(F.concat(hist, fc)).alias("r"))
    return out.select(key, "r.dt", "r.Y", "n_hist", "xmin", "xmax", "r.is_forecast", "r.seq")
