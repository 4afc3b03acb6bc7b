"""Column statistics that grow with the data: written partial moments, merged without a rescan.

Each load adds one row per day with count, mean, sum of squared deviations
(M2), minimum and maximum of every column. Partial rows merge exactly, so
means, standard deviations and ranges after an append come from the small
table, and only the appended rows are read. A load that is written again
replaces its rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.scale import MINMAX_SHIFT

PARTS = ("n", "mean", "m2", "lo", "hi")


def daily_moments(df: DataFrame, cols: list[str], day: str = "dt") -> DataFrame:
    """(day, {c}__n, {c}__mean, {c}__m2, {c}__lo, {c}__hi): partial moments; nulls are left out."""
    found = []
    for c in cols:
        n = F.count(c)
        found += [n.alias(f"{c}__n"), F.avg(c).alias(f"{c}__mean"), (F.var_pop(c) * n).alias(f"{c}__m2"),
                  F.min(c).cast("double").alias(f"{c}__lo"), F.max(c).cast("double").alias(f"{c}__hi")]
    return df.groupBy(F.col(day).alias("day")).agg(*found)


def append_moments(df: DataFrame, cols: list[str], path: str, load: str, day: str = "dt") -> DataFrame:
    """Write the moments of the rows of one load; the whole table."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", load):
        raise ValueError(f"a load is named by letters, digits, '_', '.' and '-', not {load!r}")
    daily_moments(df, cols, day).write.mode("overwrite").parquet(f"{path.rstrip('/')}/load={load}")
    return read_moments(df.sparkSession, path)


def read_moments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(moments: DataFrame, cols: list[str]) -> dict[str, DataFrame]:
    """One-row frames ``n``, ``mean``, ``std`` (sample), ``min`` and ``max`` with a column per name.

    M2 of the whole is the sum of the parts' M2 and of their counts times the
    squared distance of their mean to the common mean, which is a scalar subquery.
    """
    mean = moments.agg(*[(F.sum(F.col(f"{c}__n") * F.col(f"{c}__mean")) / F.nullif(F.sum(f"{c}__n"), F.lit(0))).alias(c)
                         for c in cols])

    def squares(c: str):
        apart = F.col(f"{c}__mean") - mean.select(c).scalar()
        return F.sum(F.col(f"{c}__m2") + F.col(f"{c}__n") * apart * apart)

    return {
        "n": moments.agg(*[F.coalesce(F.sum(f"{c}__n"), F.lit(0).cast("long")).alias(c) for c in cols]),
        "mean": mean,
        # One value has no sample deviation (null, as from the full pass).
        "std": moments.agg(*[F.sqrt(squares(c) / F.nullif(F.sum(f"{c}__n") - 1, F.lit(0))).alias(c) for c in cols]),
        "min": moments.agg(*[F.min(f"{c}__lo").alias(c) for c in cols]),
        "max": moments.agg(*[F.max(f"{c}__hi").alias(c) for c in cols]),
    }


def zscore_statistics(moments: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(mean, std) for :func:`panelcast.operators.scale.zscore`."""
    m = merged(moments, cols)
    return m["mean"], m["std"]


def minmax_statistics(moments: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(shifted min, max) for :func:`panelcast.operators.scale.minmax_shifted`."""
    m = merged(moments, cols)
    return m["min"].select(*[(F.col(c) + F.lit(MINMAX_SHIFT)).alias(c) for c in cols]), m["max"]
