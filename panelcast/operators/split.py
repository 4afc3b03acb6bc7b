"""Time-based train/test split of a panel.

``start = min(dt)``, ``train_days = int((max(dt) - start).days * fraction)``,
train is ``dt <= start + train_days`` and test is the rest. The bounds are a
one-row global aggregate used as a scalar subquery: Spark computes it once
as its own small job (a partial aggregate per task) and feeds the value to
the filter. Nothing is collected by the caller, no window spans the whole
table, and no join is planned (a join against a wide lag frame would make
Catalyst's constraint inference explode).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: share of the date span used for training.
TRAIN_FRACTION = 0.75


def split_bounds(df: DataFrame, fraction: float = TRAIN_FRACTION, dt: str = "dt") -> DataFrame:
    """One row: start_dt, end_dt, total_days, train_days, train_end."""
    agg = df.agg(F.min(dt).alias("start_dt"), F.max(dt).alias("end_dt"))
    total = F.datediff("end_dt", "start_dt")
    train_days = F.floor(total * F.lit(float(fraction))).cast(T.IntegerType())
    return agg.select("start_dt", "end_dt", total.alias("total_days"),
                      train_days.alias("train_days"),
                      F.date_add("start_dt", train_days).alias("train_end"))


def mark_split(df: DataFrame, fraction: float = TRAIN_FRACTION, dt: str = "dt",
               out: str = "is_train") -> DataFrame:
    """Add a boolean ``is_train`` column."""
    train_end = split_bounds(df, fraction, dt).select("train_end").scalar()
    return df.withColumn(out, F.col(dt) <= train_end)


def time_split(df: DataFrame, fraction: float = TRAIN_FRACTION,
               dt: str = "dt") -> tuple[DataFrame, DataFrame]:
    """``(train, test)``; test is "not train", i.e. every later date."""
    marked = mark_split(df, fraction, dt)
    train = marked.where(F.col("is_train")).drop("is_train")
    test = marked.where(~F.col("is_train")).drop("is_train")
    return train, test
