"""Series work without a per-series task: contiguous slices of the global order.

Rows are range-partitioned on ``(key, *order)`` and written once, so a long
series spreads over many slices and each slice holds contiguous pieces of
series. A piece is the part of one series in one slice; the small table of
pieces carries row counts and aggregates, and running values over it give
each piece what came before it. Rows near a piece's border are copied to the
neighbouring pieces (a halo of a few rows per piece), after which every lag
is an ordinary window over one piece.

Series keys are compared as one-field structs, so a null key is a series like
any other. ``order`` must order the rows of a series totally.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = ["_pid", "_k"]
STRATEGIES = ("window", "balanced")


def check_strategy(strategy: str) -> None:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; choose one of {', '.join(STRATEGIES)}")


@dataclass
class Slices:
    """``rows``: the input plus ``_pid`` and ``_k``. ``pieces``: ``_pid, _k, _c`` (rows),
    ``_off`` (rows before), ``_n`` (rows of the series), ``_idx`` and any aggregates asked for."""

    rows: DataFrame
    pieces: DataFrame
    order: tuple[str, ...]

    def window(self):
        return Window.partitionBy(*PIECE).orderBy(*self.order)

    def running(self):
        return self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def earlier_pieces():
    return Window.partitionBy("_k").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)


def all_pieces():
    return (Window.partitionBy("_k").orderBy("_pid")
            .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def range_slices(df: DataFrame, key: str = "code", order: tuple[str, ...] = ("dt",),
                 partitions: int | None = None, aggregates: tuple[Column, ...] = ()) -> Slices:
    """Cut ``df`` into slices; ``aggregates`` (aliased) are computed per piece.

    The slices are written under the checkpoint folder: range bounds come from
    sampling, so slice numbers must come from a single evaluation. Their number
    is ``partitions`` or the session's shuffle partitions.
    """
    from panelcast.session import materialize

    p = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.withColumn("_k", F.struct(F.col(key).alias("k")))
              .repartitionByRange(p, key, *order).withColumn("_pid", F.spark_partition_id()))
    rows = materialize(ranged, "series-slices")
    pieces = (rows.groupBy(*PIECE).agg(F.count(F.lit(1)).alias("_c"), *aggregates)
              .withColumn("_off", F.coalesce(F.sum("_c").over(earlier_pieces()), F.lit(0)))
              .withColumn("_n", F.sum("_c").over(all_pieces()))
              .withColumn("_idx", F.row_number().over(Window.partitionBy("_k").orderBy("_pid"))))
    return Slices(rows, pieces, order)


def series_positions(df: DataFrame, key: str = "code", order: tuple[str, ...] = ("dt",),
                     partitions: int | None = None, out: str = "_pos",
                     size: str | None = None) -> DataFrame:
    """1-based row number within each series (and with ``size`` the series' row count)."""
    s = range_slices(df, key, order, partitions)
    d = s.rows.join(s.pieces.select(*PIECE, "_off", "_n"), PIECE)
    d = d.withColumn(out, F.col("_off") + F.row_number().over(s.window()))
    if size:
        d = d.withColumn(size, F.col("_n"))
    return d.drop(*PIECE, "_off", "_n")


def with_halo(s: Slices, n: int, mode: str = "backward") -> DataFrame:
    """``s.rows`` plus, per piece, the ``n`` rows before it (``backward``) or after it.

    Halo rows carry the ``_pid`` of the piece that needs them and ``_halo`` true.
    A piece gives its border rows to the next ``n`` pieces of the series at
    most, as every piece has a row; those too far away are left out.
    """
    own = s.rows.withColumn("_halo", F.lit(False))
    if n < 1:
        return own
    back = mode == "backward"
    by = Window.partitionBy(*PIECE).orderBy(*[F.desc(c) if back else F.asc(c) for c in s.order])
    edge = s.rows.withColumn("_e", F.row_number().over(by)).where(F.col("_e") <= n)
    at = (F.col("_off") + F.col("_c") - F.col("_e") + 1) if back else F.col("_off") + F.col("_e")
    edge = (edge.join(s.pieces.select(*PIECE, "_off", "_c", "_idx"), PIECE)
            .withColumn("_at", at).drop("_pid", "_off", "_c", "_e")
            .withColumn("_idx", F.explode(F.transform(
                F.sequence(F.lit(1), F.lit(n)), lambda j: F.col("_idx") + (j if back else -j)))))
    target = s.pieces.select("_k", "_idx", "_pid", (F.col("_off") + 1).alias("_first"),
                             (F.col("_off") + F.col("_c")).alias("_last"))
    apart = F.col("_first") - F.col("_at") if back else F.col("_at") - F.col("_last")
    halo = edge.join(target, ["_k", "_idx"]).where(apart <= n).withColumn("_halo", F.lit(True))
    return own.unionByName(halo.select(*own.columns))
