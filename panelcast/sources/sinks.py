"""Sinks: per-series forecast CSV files, and model save / load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORECAST_SCHEMA = T.StructType([
    T.StructField("dt", T.DateType(), True),
    T.StructField("unscale_pred", T.DoubleType(), True),
    T.StructField("code", T.StringType(), True),
])


def write_forecast_csv(df: DataFrame, path: str, key: str = "code", pieces: int = 1) -> str:
    """One folder per series (``code=<key>/``) of CSV files with a header.

    Rows are dealt out by key before the write, so a series is one file,
    whatever plan the frame comes from (and no second shuffle follows a frame
    that is dealt by key already). ``pieces`` above 1 salts the key, for a
    series too long for one task: it is then that many files. The key
    lives in the folder name.
    """
    rows = df.select(key, "dt", "unscale_pred")
    if pieces > 1:
        rows = rows.repartition(key, F.pmod(F.xxhash64("dt", "unscale_pred"), F.lit(pieces)))
    else:
        rows = rows.repartition(key)
    rows.write.mode("overwrite").partitionBy(key).option("header", True).csv(path)
    return path


def read_forecast_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read the per-series CSV folders back, the key recovered from the path."""
    return (spark.read.schema(FORECAST_SCHEMA).option("header", True).csv(path)
            .select("code", "dt", "unscale_pred"))
