"""Normalisation: global z-score and shifted min-max, per-series range scaling.

Global statistics are one-row aggregates read as scalar subqueries (the
aggregate is partial on every task, so it never gathers the table, and
Spark merges the subqueries over the same input into one job). Fitted
statistics are returned as one-row DataFrames and can be passed back in to
scale another frame (e.g. test with train statistics).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.lags import whole_series
from panelcast.operators.slices import check_strategy

# Shift added to the minimum of the min-max scaler, and the
# target interval of the per-series range scaling.
MINMAX_SHIFT = 1e-3
SCALE_MIN = 70.0
SCALE_MAX = 3000.0


def _apply(df: DataFrame, cols: list[str], a: DataFrame, b: DataFrame, expr) -> DataFrame:
    out = [expr(F.col(c), a.select(c).scalar(), b.select(c).scalar()).alias(c)
           if c in cols else F.col(c) for c in df.columns]
    return df.select(*out)


def zscore(df: DataFrame, cols: list[str], mean: DataFrame | None = None,
           std: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(x - mean) / std`` (sample std). If either statistic is missing both are fitted."""
    if mean is None or std is None:
        mean = df.agg(*[F.avg(c).alias(c) for c in cols])
        std = df.agg(*[F.stddev_samp(c).alias(c) for c in cols])
    scaled = _apply(df, cols, mean, std, lambda x, m, s: F.try_divide(x - m, s))
    return scaled, mean, std


def minmax_shifted(df: DataFrame, cols: list[str], lo: DataFrame | None = None,
                   hi: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(x - (min + 1e-3)) / (max - (min + 1e-3))``; a constant column maps to 1."""
    if lo is None or hi is None:
        lo = df.agg(*[(F.min(c) + F.lit(MINMAX_SHIFT)).alias(c) for c in cols])
        hi = df.agg(*[F.max(c).alias(c) for c in cols])
    scaled = _apply(df, cols, lo, hi, lambda x, a, b: F.try_divide(x - a, b - a))
    return scaled, lo, hi


def range_scale(y: Column, lo: Column, hi: Column,
                scale_min: float = SCALE_MIN, scale_max: float = SCALE_MAX) -> Column:
    """``(smax - smin) * (y - lo) / (hi - lo) + smin``; null for a constant series."""
    return F.try_divide(F.lit(scale_max - scale_min) * (y - lo), hi - lo) + F.lit(scale_min)


def range_unscale(p: Column, lo: Column, hi: Column,
                  scale_min: float = SCALE_MIN, scale_max: float = SCALE_MAX) -> Column:
    """Inverse of :func:`range_scale`: ``(hi - lo) * (p - smin) / (smax - smin) + lo``."""
    return (hi - lo) * (p - F.lit(scale_min)) / F.lit(scale_max - scale_min) + lo


def range_scale_by_code(df: DataFrame, col: str = "Y", out: str = "Y_scaled",
                        key: str = "code", order: tuple[str, ...] = ("dt",),
                        scale_min: float = SCALE_MIN,
                        scale_max: float = SCALE_MAX, strategy: str = "window") -> DataFrame:
    """Scale each series to [smin, smax]; carries ``xmin``/``xmax`` for the inverse.

    ``strategy="balanced"`` joins a combining aggregate back instead of a window.
    """
    check_strategy(strategy)
    if strategy == "balanced":
        ends = df.groupBy(F.col(key).alias("_key")).agg(F.min(col).alias("xmin"), F.max(col).alias("xmax"))
        d = df.join(ends, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    else:
        w = whole_series(key, order)
        d = df.withColumn("xmin", F.min(col).over(w)).withColumn("xmax", F.max(col).over(w))
    return (d.withColumn(out, range_scale(F.col(col), F.col("xmin"), F.col("xmax"),
                                           scale_min, scale_max)))
