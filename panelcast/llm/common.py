"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of ``df`` (case-insensitively)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(column: str) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the maximal runs of non-white characters."""
    return F.array_remove(F.split(text, SPACE), "")


def pinned(column: Column) -> Column:
    """The column, evaluated where it is defined.

    A filter on a derived column is pushed down by copying the column's
    expression, also into lambdas, where it would be evaluated per element.
    Projections that are marked as depending on the partition are not crossed.
    """
    return F.when(F.spark_partition_id() >= 0, column)


#: Keys that hold more than this share of the rows are joined by broadcast; there are at most as many.
HEAVY = 4096


def join_counted(rows: DataFrame, keyed: DataFrame, on: str, weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` to ``keyed`` (one row per key) that no common key skews.

    ``weight`` says how many rows have a key, of ``total`` in all. Keys that hold
    at least 1/``HEAVY`` of them are at most ``HEAVY`` and are broadcast; the
    rows of the others are shuffled, and no such key weighs on a task.
    """
    heavy = F.col(weight) * F.lit(HEAVY) >= F.lit(total)
    few, many = keyed.where(heavy), keyed.where(~heavy)
    near = rows.join(F.broadcast(few), on)
    far = rows.join(F.broadcast(few.select(on)), on, "left_anti").join(many.hint("shuffle_hash"), on)
    return near.unionByName(far)
