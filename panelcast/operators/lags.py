"""Sliding lag / lead frames over every series of a panel.

One window specification, ``partitionBy(code).orderBy(dt[, ordinal])``, is
shared by every lag column and by the per-series row count, so the whole
frame is planned as a single hash exchange on ``code``, one sort and one
Window node, however many columns it has.

Scale note: a panel holds one row per (code, date) after aggregation, so the
rows one window task sees for a code are bounded by the number of distinct
dates, not by the raw data volume behind that code. For un-aggregated input,
where one series may hold a large share of all rows, ``strategy="balanced"``
computes the same frame without ever giving a whole series to one task (see
:mod:`panelcast.operators.slices`). The caller chooses; results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.slices import PIECE, check_strategy, range_slices, with_halo

# The lag column name pattern ("day" means row), the sentinel
# threshold below which a cell counts as missing, and the default depth.
LAG_NAME = "{col}_{i:03d}_day_before"
SENTINEL_THRESHOLD = -10000000.0
DEFAULT_TRACKING_DAYS = 5

MODES = ("backward", "forward")


def lag_name(col: str, i: int) -> str:
    return LAG_NAME.format(col=col, i=i)


def series_window(key: str = "code", order: tuple[str, ...] = ("dt",)):
    return Window.partitionBy(key).orderBy(*order)


def whole_series(key: str = "code", order: tuple[str, ...] = ("dt",)):
    """Same partitioning and order as :func:`series_window`, full frame.

    Keeping the order on the count lets Spark evaluate it in the same Window
    node as the lags instead of adding a second sort.
    """
    return series_window(key, order).rowsBetween(Window.unboundedPreceding,
                                                 Window.unboundedFollowing)


def value_columns(df: DataFrame, key: str = "code",
                  order: tuple[str, ...] = ("dt",)) -> list[str]:
    return [c for c in df.columns if c not in (key, "dt", *order)]


def lag_frame(df: DataFrame, tracking_days: int = DEFAULT_TRACKING_DAYS,
              mode: str = "backward", drop_null: bool = True,
              columns: list[str] | None = None, key: str = "code",
              order: tuple[str, ...] = ("dt",), carry: tuple[str, ...] = (),
              strategy: str = "window") -> DataFrame:
    """Shift every value column 0..N rows within each series.

    For column ``c`` and ``i`` in ``0..N`` emits ``c_{iii}_day_before``: the
    value ``i`` rows earlier (``backward``) or later (``forward``; the names
    are kept). Series with fewer than ``N + 2`` rows are skipped. With
    ``drop_null`` rows with any missing shifted value (the first/last ``N``
    rows of each series) are dropped. Shifted columns are doubles, ordered
    lexicographically after ``key, dt``; ``carry`` columns (constant per
    series, e.g. scaling bounds) pass through unshifted at the end.

    ``strategy="window"`` evaluates everything in one Window node per series;
    ``"balanced"`` evaluates it per piece of a series, so no task holds a
    whole series.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; choose one of {', '.join(MODES)}")
    check_strategy(strategy)
    n = int(tracking_days)
    cols = columns if columns is not None else value_columns(df, key, order)
    if strategy == "balanced":
        extra = [c for c in order if c != "dt" and c not in carry]
        sl = range_slices(df.select(key, "dt", *extra, *cols, *carry), key, order)
        source = (with_halo(sl, n, mode).join(sl.pieces.select(*PIECE, "_n"), PIECE))
        w, keep, size = sl.window(), ["_halo"], F.col("_n")
    else:
        source, w, keep = df, series_window(key, order), []
        size = F.count(F.lit(1)).over(whole_series(key, order))
    shift = F.lag if mode == "backward" else F.lead
    shifted: dict[str, Column] = {}
    for c in cols:
        for i in range(n + 1):
            v = F.col(c) if i == 0 else shift(c, i).over(w)
            shifted[lag_name(c, i)] = v.cast(T.DoubleType())
    names = sorted(shifted)
    framed = source.select(key, "dt", *[shifted[k].alias(k) for k in names], *carry, *keep,
                           size.alias("_n"))
    if keep:
        framed = framed.where(~F.col("_halo"))
    framed = framed.where(F.col("_n") >= n + 2).drop("_n")
    if drop_null:
        framed = framed.dropna(how="any", subset=names)
    return framed.select(key, "dt", *names, *carry)


def short_series_filter(df: DataFrame, tracking_days: int = DEFAULT_TRACKING_DAYS,
                        key: str = "code", order: tuple[str, ...] = ("dt",),
                        strategy: str = "window") -> DataFrame:
    """Keep only series with at least ``N + 2`` rows."""
    check_strategy(strategy)
    if strategy == "balanced":
        sizes = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
        enough = sizes.where(F.col("_n") >= tracking_days + 2)
        return df.join(enough, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    n = F.count(F.lit(1)).over(whole_series(key, order))
    return df.withColumn("_n", n).where(F.col("_n") >= tracking_days + 2).drop("_n")


def drop_sentinels(df: DataFrame, columns: list[str] | None = None,
                   threshold: float = SENTINEL_THRESHOLD) -> DataFrame:
    """Treat any cell below ``threshold`` as missing and drop its row.

    Rows with an already missing cell are dropped as well, matching "replace
    by missing, then drop missing". The test is a single ``least(...)``
    predicate over the row rather than one conjunct per column: with dozens
    of columns, separate conjuncts make Catalyst's constraint inference grow
    combinatorially in later joins.
    """
    cols = columns if columns is not None else [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.IntegerType, T.LongType))]
    if not cols:
        return df
    low = F.lit(float("-inf"))
    cells = [F.coalesce(F.nanvl(F.col(c).cast(T.DoubleType()), low), low) for c in cols]
    lowest = F.least(*cells) if len(cells) > 1 else cells[0]
    return df.where(lowest >= F.lit(threshold))


def label_from_lag0(df: DataFrame, col: str = "Y") -> DataFrame:
    """Rename the unshifted copy of the target back to the target name."""
    return df.withColumnRenamed(lag_name(col, 0), col)
