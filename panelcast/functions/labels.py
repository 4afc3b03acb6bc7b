"""Event-within-horizon labels: is a known fault date close after this row?

Two rules over ``d = fault_date - dt`` (days):

* ``intent``  -- 1 iff ``0 < d <= horizon`` (the stated "within 30 days").
* ``literal`` -- the rule as the source expression evaluates it, where the
  bitwise ``&`` binds before the comparisons:
  ``d <= (horizon & d)  and  (horizon & d) > 0``. For positive d that keeps
  only even days 2..30; d = 0 gives 0; negative d gives 1 unless
  ``d mod 32`` is 0 or 1.

A row whose series has no fault date gets 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.scalar import parse_date

# Label horizon in days and the two date formats of the
# source rows ("%Y%m%d") and of the fault dictionary ("%Y-%m-%d").
HORIZON_DAYS = 30
ROW_DATE_FORMAT = "yyyyMMdd"
FAULT_DATE_FORMAT = "yyyy-MM-dd"

RULES = ("intent", "literal")


def label_intent(d: Column, horizon: int = HORIZON_DAYS) -> Column:
    return F.when((d > 0) & (d <= horizon), 1).otherwise(0)


def label_literal(d: Column, horizon: int = HORIZON_DAYS) -> Column:
    masked = F.lit(horizon).bitwiseAND(d)
    return F.when((d <= masked) & (masked > 0), 1).otherwise(0)


def label_expr(d: Column, rule: str = "intent", horizon: int = HORIZON_DAYS) -> Column:
    if rule == "intent":
        return label_intent(d, horizon)
    if rule == "literal":
        return label_literal(d, horizon)
    raise ValueError(f"unknown label rule {rule!r}; expected one of {RULES}")


def label_rows(df: DataFrame, faults: DataFrame, rule: str = "intent",
               horizon: int = HORIZON_DAYS, key: str = "code", dt: str = "dt",
               fault_col: str = "fault_date", dt_format: str | None = None,
               fault_format: str | None = None, out: str = "label",
               on_bad_date: str = "raise") -> DataFrame:
    """Left-join the fault dictionary on the series key and label each row.

    A malformed date is an error, or with ``on_bad_date="null"`` no fault.
    """
    f = faults.select(F.col(key).alias("__fkey"),
                      parse_date(fault_col, fault_format, on_bad_date).alias("__fault"))
    joined = df.join(f, df[key] == f["__fkey"], "left")
    d = F.datediff(F.col("__fault"), parse_date(dt, dt_format, on_bad_date))
    return (joined.withColumn(out, label_expr(d, rule, horizon))
            .drop("__fkey", "__fault"))
