"""Lag frames of a growing panel: appended rows cost only themselves.

A written state holds the last ``N + 1`` rows of every series and how many
rows the series has had. An append puts its rows behind those of the state,
builds the lag frame of that little frame, and keeps what is new: the rows of
the append and, of a series that has just become long enough, the one row
that was held back while it was too short. All appends together give the
frame of all rows at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators import lags
from panelcast.session import materialize


@dataclass
class LagState:
    """``rows``: key, order and value columns, and ``_seen``, the rows of the series so far (written)."""

    rows: DataFrame
    tracking_days: int
    columns: tuple[str, ...]
    order: tuple[str, ...]


def _last_rows(df: DataFrame, n: int, order: tuple[str, ...]) -> DataFrame:
    """The last ``n`` rows of every series; a task keeps no more than these before the shuffle."""
    back = Window.partitionBy("code").orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= n).drop("_r")


def append(state: LagState | None, new: DataFrame, tracking_days: int = lags.DEFAULT_TRACKING_DAYS,
           columns: list[str] | None = None, order: tuple[str, ...] = ("dt",),
           strategy: str = "window") -> tuple[DataFrame, LagState]:
    """(lag frame rows that the append adds, the state after it); both are written.

    The new rows of a series must come after its earlier ones in ``order``; a row
    that does not is an error. The first append (``state`` None) sets depth,
    columns and order, the others go on with them.
    """
    if state is not None:
        tracking_days, columns, order = state.tracking_days, list(state.columns), state.order
    cols = columns if columns is not None else lags.value_columns(new, order=order)
    n = int(tracking_days)
    names = ["code", *dict.fromkeys([*order, "dt"]), *[c for c in cols if c not in order]]
    rows = new.select(*names, F.lit(False).alias("_old"))
    key = F.struct("code")  # a null key is a series like any other
    fresh = rows.groupBy(key.alias("_k")).agg(F.count(F.lit(1)).alias("_added"), F.min(F.struct(*order)).alias("_first"))
    if state is None:
        both = rows.withColumn("_seen", F.lit(0).cast("long"))
        counted = fresh.select("_k", F.col("_added").alias("_total"))
    else:
        held = state.rows.groupBy(key.alias("_k")).agg(F.max("_seen").alias("_seen"), F.max(F.struct(*order)).alias("_last"))
        met = held.join(fresh, "_k", "full")
        late = F.raise_error(F.concat(F.lit("rows of the append do not come after the earlier rows of series "),
                                      F.coalesce(F.col("_k.code").cast("string"), F.lit("null"))))
        seen = F.coalesce("_seen", F.lit(0).cast("long"))
        met = materialize(met.select(
            "_k", F.when(F.col("_first") <= F.col("_last"), late.cast("long")).otherwise(seen).alias("_seen"),
            (seen + F.coalesce("_added", F.lit(0).cast("long"))).alias("_total")), "lag-counts")
        old = state.rows.drop("_seen").withColumn("_old", F.lit(True))
        both = (old.unionByName(rows).withColumn("_k", key).join(met.select("_k", "_seen"), "_k").drop("_k"))
        counted = met.select("_k", "_total")
    both = materialize(both, "lag-rows")
    framed = lags.lag_frame(both, n, columns=cols, order=order, carry=("_old", "_seen"), strategy=strategy)
    added = framed.where(~F.col("_old") | (F.col("_seen") < n + 2)).drop("_old", "_seen")
    kept = (_last_rows(both.drop("_seen", "_old"), n + 1, order).withColumn("_k", key)
            .join(counted.withColumnRenamed("_total", "_seen"), "_k").drop("_k"))
    return materialize(added, "lag-added"), LagState(materialize(kept, "lag-state"), n, tuple(cols), tuple(order))
