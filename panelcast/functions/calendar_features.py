"""Calendar features of a date column, as one projection of built-in expressions.

Column meanings follow the reference feature set:

* ``year``, ``month``, ``day``            calendar parts
* ``week``                                 ISO-8601 week number
* ``weekday``, ``isoweekday``              both Monday=1 .. Sunday=7
* ``weekofyear``                           ``strftime('%W')``: Monday-based,
                                           days before the first Monday are week 0
* ``dayofyear``, ``dayofmonth``            ``%j``, ``%d``
* ``days2``                                ``(year-2018) + (month-1)*30 + day``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.scalar import col_of

# Feature names in the order they are generated, and the
# constants of the ``days2`` feature.
CALENDAR_COLUMNS = ("year", "month", "day", "week", "weekday", "isoweekday",
                    "weekofyear", "dayofyear", "dayofmonth", "days2")
DAYS2_BASE_YEAR = 2018
DAYS2_DAYS_PER_MONTH = 30


def iso_weekday(d: Column) -> Column:
    """Monday=1 .. Sunday=7 (Spark's ``weekday`` is Monday=0)."""
    return F.weekday(d) + 1


def monday_week_of_year(d: Column) -> Column:
    """``strftime('%W')`` as integer arithmetic: (doy + 7 - isoweekday) div 7."""
    return ((F.dayofyear(d) + 7 - iso_weekday(d)) / 7).cast(T.IntegerType())


def days2(d: Column) -> Column:
    return ((F.year(d) - DAYS2_BASE_YEAR)
            + (F.month(d) - 1) * DAYS2_DAYS_PER_MONTH
            + F.dayofmonth(d))


def calendar_exprs(dt: str | Column = "dt") -> list[Column]:
    d = col_of(dt)
    iso = iso_weekday(d)
    exprs = {
        "year": F.year(d),
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "week": F.weekofyear(d),
        "weekday": iso,
        "isoweekday": iso,
        "weekofyear": monday_week_of_year(d),
        "dayofyear": F.dayofyear(d),
        "dayofmonth": F.dayofmonth(d),
        "days2": days2(d),
    }
    return [exprs[name].cast(T.IntegerType()).alias(name) for name in CALENDAR_COLUMNS]


def add_calendar_features(df: DataFrame, dt: str = "dt") -> DataFrame:
    """Append the ten calendar columns (replacing any of the same name)."""
    keep = [c for c in df.columns if c not in CALENDAR_COLUMNS and c != "index"]
    return df.select(*keep, *calendar_exprs(dt))
