"""CSV loads that keep what they cannot read.

A line whose fields do not fit the schema (a load that is no number, a missing or
surplus field, a date that is none) is never turned into nulls: it is either
an error (``readers.read_csv`` as it comes) or, here, a row of a written
ledger with its place, its text and the reason. Loaded and rejected rows
together are all lines of the input.

The ledger has one folder per load, which a repeated load replaces, so it
never holds a line twice. Only rejected lines are written; loaded rows stay a
lazy scan with the same test as a filter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.sources.readers import (CORRUPT, ORDINAL, RAW_SCHEMA, field_problems, scan_lines, typed_fields,
                                       with_input_ordinal)

PLACE = "_place"

LEDGER_SCHEMA = "load string, file string, split long, row long, record string, column string, reason string"


@dataclass
class Load:
    """``rows`` that fit the schema, and the written ``rejects`` of this load."""

    rows: DataFrame
    rejects: DataFrame


def load_csv(spark: SparkSession, path: str, ledger: str, load: str, schema: T.StructType = RAW_SCHEMA,
             header: bool = True, dates: dict[str, str] | None = None, ordinal: bool = False) -> Load:
    """Read ``path``; rejected lines go to the folder ``load=<load>`` of ``ledger``.

    ``dates`` maps text columns to the date pattern that their values must
    match. A line may have several ledger rows, one per bad field. With
    ``ordinal`` the loaded rows carry their place in the input.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", load):
        raise ValueError(f"a load is named by letters, digits, '_', '.' and '-', not {load!r}")
    lines = scan_lines(spark, path, schema, header)
    tagged = with_input_ordinal(lines, PLACE)
    problems = field_problems(schema, dates)
    text = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*[F.col(f"`{f.name}`") for f in schema.fields])))
    rejects = tagged.where(F.size(problems) > 0).select(f"{PLACE}.file", f"{PLACE}.split", f"{PLACE}.row",
                                                        text.alias("record"), F.explode(problems).alias("x"))
    folder = f"{ledger.rstrip('/')}/load={load}"
    rejects.select("file", "split", "row", "record", "x.column", "x.reason").write.mode("overwrite").parquet(folder)
    place = [F.col(PLACE).alias(ORDINAL)] if ordinal else []
    rows = (tagged if ordinal else lines).where(F.size(problems) == 0).select(*typed_fields(schema), *place)
    return Load(rows, read_ledger(spark, ledger).where(F.col("load") == load))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All loads' rejected lines."""
    return spark.read.schema(LEDGER_SCHEMA).parquet(ledger)


def rejected_counts(rejects: DataFrame) -> DataFrame:
    """Per load: rejected lines and bad fields."""
    return rejects.groupBy("load").agg(
        F.countDistinct("file", "split", "row").alias("n_lines"), F.count(F.lit(1)).alias("n_fields"))
