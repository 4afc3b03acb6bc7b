"""Per-series transforms: forward fill and the daily date spine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.slices import PIECE, check_strategy, earlier_pieces, range_slices
from panelcast.session import materialize


def forward_fill(df: DataFrame, col: str = "Y", out: str | None = None,
                 key: str = "code", order: tuple[str, ...] = ("dt",),
                 strategy: str = "window") -> DataFrame:
    """Carry the last non-missing value forward within each series.

    ``strategy="balanced"`` fills within the pieces of a series and takes what
    comes before a piece from the table of pieces, so no task holds a whole series.
    """
    check_strategy(strategy)
    if strategy == "balanced":
        known = F.when(F.col(col).isNotNull(), F.struct(*order))
        sl = range_slices(df, key, order, aggregates=(F.max_by(col, known).alias("_last"),))
        before = sl.pieces.select(*PIECE, F.last("_last", ignorenulls=True).over(earlier_pieces()).alias("_before"))
        inside = F.last(col, ignorenulls=True).over(sl.running())
        return (sl.rows.join(before, PIECE).withColumn("_in", inside)
                .withColumn(out or col, F.coalesce("_in", "_before")).drop(*PIECE, "_in", "_before"))
    w = (Window.partitionBy(key).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(out or col, F.last(col, ignorenulls=True).over(w))


def forward_fill_frame(df: DataFrame, col: str = "Y", out: str | None = None,
                       order: tuple[str, ...] = ("code", "dt"), partitions: int | None = None) -> DataFrame:
    """Carry the last non-missing value forward through the whole frame in ``order``,
    across series borders.

    The frame is cut into slices of its order (range partitions, written once);
    each slice's last known value is one row, a running value over these rows
    gives every slice what came before it, and a slice is filled by a window of
    its own. ``order`` must order the rows totally, so that a slice can end anywhere.
    """
    p = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = materialize(df.repartitionByRange(p, *order).withColumn("_pid", F.spark_partition_id()), "frame-slices")
    known = F.when(F.col(col).isNotNull(), F.struct(*order))
    last = slices.groupBy("_pid").agg(F.max_by(col, known).alias("_last"))
    # One row per slice, whatever the number of rows.
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select("_pid", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    running = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (slices.join(before, "_pid").withColumn("_in", F.last(col, ignorenulls=True).over(running))
            .withColumn(out or col, F.coalesce("_in", "_before")).drop("_pid", "_in", "_before"))


def daily_spine(panel: DataFrame, value: str = "Y", key: str = "code") -> DataFrame:
    """Every calendar day from each series' first to last date.

    Days without a row get a missing ``value``. Each row expands to itself
    plus the gap up to the next row of its series, so the spine is built in
    the same code-partitioned pass as the window (no join, no second
    shuffle) and its size is bounded by each series' date span.
    Requires one row per (code, dt).
    """
    w = Window.partitionBy(key).orderBy("dt")
    nxt = F.lead("dt").over(w)
    last_day = F.greatest(F.col("dt"), F.coalesce(F.date_sub(nxt, 1), F.col("dt")))
    bounded = panel.select(key, "dt", value, last_day.alias("_last"))
    expanded = bounded.select(key, "dt", value,
                              F.explode(F.sequence(F.col("dt"), F.col("_last"))).alias("_day"))
    return expanded.select(
        key, F.col("_day").alias("dt"),
        F.when(F.col("_day") == F.col("dt"), F.col(value)).alias(value))


def fill_sentinel(df: DataFrame, col: str, sentinel: float) -> DataFrame:
    """Code missing values with a sentinel number (how gap days often arrive)."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(float(sentinel))))
