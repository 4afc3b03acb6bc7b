"""Error metrics as grouped aggregates (overall, per split, per series).

Truth and prediction are always read from the same row. A zero truth makes
the percentage error undefined: such rows are left out of MAPE (no ANSI
division error) and counted in ``n_zero_truth``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def abs_pct_error(y: str | Column, pred: str | Column) -> Column:
    y = F.col(y) if isinstance(y, str) else y
    pred = F.col(pred) if isinstance(pred, str) else pred
    return F.abs(F.try_divide(pred - y, y))


def mape(df: DataFrame, y: str = "Y", pred: str = "prediction",
         by: list[str] | None = None, decimals: int | None = None) -> DataFrame:
    """``mean(|(pred - y) / y|)`` per group, with scored and skipped counts."""
    ape = abs_pct_error(y, pred)
    m = F.avg(ape)
    if decimals is not None:
        m = F.round(m, decimals)
    aggs = [m.alias("mape"), F.count(ape).alias("n_scored"),
            F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("n_zero_truth")]
    return df.groupBy(*(by or [])).agg(*aggs)


def rmse(df: DataFrame, y: str = "Y", pred: str = "prediction",
         by: list[str] | None = None, decimals: int | None = None) -> DataFrame:
    """``sqrt(mean((pred - y)^2))`` per group."""
    r = F.sqrt(F.avg(F.pow(F.col(pred) - F.col(y), 2)))
    if decimals is not None:
        r = F.round(r, decimals)
    return df.groupBy(*(by or [])).agg(r.alias("rmse"), F.count(F.col(pred) - F.col(y)).alias("n_scored"))
