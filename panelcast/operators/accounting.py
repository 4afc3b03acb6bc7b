"""Row accounts: what each cleaning step removes, counted by the pass that removes it.

Every step marks its rows with the first reason that drops them and observes
the marks (``DataFrame.observe``) before it filters, so the counts come from the
job that computes the result and no second scan is planned. The counts are
there once an action on the result has run.

Observed counts are kept per task; a stage that is computed again after a lost
executor can count its rows twice. Steps that follow each other without a
change of rows must agree, and :meth:`RowAccount.counts` raises where they do not.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.scalar import nan_to_null
from panelcast.operators import lags
from panelcast.operators.panel import drop_missing

COUNTS_SCHEMA = "step int, name string, reason string, n_rows long"
KEPT = "kept"


class RowAccount:
    """The observed counts of the steps of one result."""

    def __init__(self):
        self._steps: list[tuple[str, Observation, list[str], str | None]] = []

    def observe(self, df: DataFrame, name: str, reasons: dict[str, Column], follows: str | None = None) -> DataFrame:
        """``df`` without the rows that a condition of ``reasons`` drops, the first one counting.

        ``follows`` names an earlier step whose kept rows are the rows of this one.
        """
        taken = F.lit(KEPT)
        for reason, condition in reversed(list(reasons.items())):
            taken = F.when(condition, F.lit(reason)).otherwise(taken)
        marked = df.withColumn("_reason", taken)
        names = [*reasons, KEPT]
        step = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
        counts = [F.count(F.when(F.col("_reason") == r, F.lit(1))).alias(r) for r in names]
        marked = marked.observe(step, *counts)
        self._steps.append((name, step, names, follows))
        return marked.where(F.col("_reason") == KEPT).drop("_reason")

    def counts(self) -> dict[str, dict[str, int]]:
        """Step -> reason -> rows. Waits for the first action on the result."""
        found: dict[str, dict[str, int]] = {}
        for name, step, names, follows in self._steps:
            got = step.get
            found[name] = {r: int(got[r]) for r in names}
            if follows is not None and sum(found[name].values()) != found[follows][KEPT]:
                raise RuntimeError(f"step {name!r} counted {sum(found[name].values())} rows after {found[follows][KEPT]} "
                                   f"kept by {follows!r}: a stage was computed again; run the action once more")
        return found

    def table(self, spark) -> DataFrame:
        """The counts as rows (step, name, reason, n_rows)."""
        rows = [(i, name, reason, n) for i, (name, reasons) in enumerate(self.counts().items())
                for reason, n in reasons.items()]
        return spark.createDataFrame(rows, COUNTS_SCHEMA)


def clean_measurements(raw: DataFrame, account: RowAccount, date_col: str = "time_key", site_col: str = "sites",
                       node_col: str = "node_desc", load_col: str = "ds_load", keep: tuple[str, ...] = ()) -> DataFrame:
    """:func:`panelcast.operators.panel.clean_measurements` with an account: rows
    without a date, then without a key, then without a load (or a NaN) are dropped."""
    df = raw.select(F.col(date_col).alias("date"),
                    F.concat(F.col(site_col).cast(T.StringType()), F.col(node_col)).alias("market"),
                    nan_to_null(F.col(load_col).cast(T.DoubleType())).alias("value"), *keep)
    out = account.observe(df, "clean", {
        "null_date": F.col("date").isNull(), "null_key": F.col("market").isNull(), "null_load": F.col("value").isNull()})
    return drop_missing(out, list(keep)) if keep else out


def model_frame(panel: DataFrame, account: RowAccount, tracking_days: int = lags.DEFAULT_TRACKING_DAYS,
                columns: list[str] | None = None, order: tuple[str, ...] = ("dt",),
                threshold: float = lags.SENTINEL_THRESHOLD) -> DataFrame:
    """Lag frame without its edge rows and sentinels, label renamed, with an account.

    Steps: ``series`` drops the rows of series of fewer than ``N + 2`` rows;
    ``lags`` drops rows with a missing shifted value, then rows with a cell
    below ``threshold``.
    """
    cols = columns if columns is not None else lags.value_columns(panel, order=order)
    size = F.count(F.lit(1)).over(lags.whole_series(order=order))
    sized = account.observe(panel.withColumn("_n", size), "series",
                            {"short_series": F.col("_n") < tracking_days + 2}).drop("_n")
    framed = lags.lag_frame(sized, tracking_days, columns=cols, order=order, drop_null=False)
    names = [c for c in framed.columns if c not in ("code", "dt")]
    missing = F.lit(False)
    for c in names:
        missing = missing | F.col(c).isNull() | F.isnan(c)
    lowest = F.least(*[F.col(c) for c in names]) if len(names) > 1 else F.col(names[0])
    kept = account.observe(framed, "lags", {"missing_lag": missing, "sentinel": lowest < threshold}, follows="series")
    return lags.label_from_lag0(kept)
