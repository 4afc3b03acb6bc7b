"""Scalar column expressions shared by the operators (all JVM built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """NaN becomes null, so a single missing-value model holds downstream."""
    c = col_of(c)
    return F.nanvl(c, F.lit(None).cast(T.DoubleType()))


ON_BAD_DATE = ("raise", "null")


def parse_date(c: str | Column, fmt: str | None = None, on_bad: str = "raise") -> Column:
    """String to date with an explicit pattern; dates and timestamps pass through.

    With ``fmt=None`` the value is cast, which accepts ISO strings, dates and
    timestamps. A value that is no date raises an error (in any session), or
    becomes null with ``on_bad="null"``; null stays null.
    """
    if on_bad not in ON_BAD_DATE:
        raise ValueError(f"unknown on_bad {on_bad!r}; choose one of {', '.join(ON_BAD_DATE)}")
    c = col_of(c)
    parsed = c.try_cast(T.DateType()) if fmt is None else F.try_to_date(c, fmt)
    if on_bad == "null":
        return parsed
    error = F.raise_error(F.concat(F.lit("not a date: "), c.cast("string"))).cast(T.DateType())
    return F.when(parsed.isNull() & c.isNotNull(), error).otherwise(parsed)
