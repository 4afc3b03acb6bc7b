"""Panel construction: raw measurements -> (code, dt, Y).

A panel is a long table of many irregular series, one row per
(series key ``code``, date ``dt``) with one measure ``Y``. Series order is
defined by ``dt`` and, where a date repeats inside a code, by an input
ordinal column (see :func:`panelcast.sources.readers.with_input_ordinal`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.scalar import nan_to_null, parse_date
from panelcast.session import materialize
from panelcast.sources.readers import ORDINAL


def key_market(raw: DataFrame, site_col: str = "sites", node_col: str = "node_desc",
               out: str = "market") -> DataFrame:
    """``market = concat(site, node)`` (null if either part is null), parts dropped."""
    return (raw.withColumn(out, F.concat(F.col(site_col).cast(T.StringType()),
                                         F.col(node_col)))
            .drop(site_col).drop(node_col))


def drop_missing(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with any null or NaN (Spark's ``dropna`` treats NaN as missing)."""
    return df.dropna(how="any", subset=subset)


def clean_measurements(raw: DataFrame, date_col: str = "time_key",
                       site_col: str = "sites", node_col: str = "node_desc",
                       load_col: str = "ds_load",
                       keep: tuple[str, ...] = ()) -> DataFrame:
    """Key, rename and clean a raw table into ``(date, market, value)``.

    One projection (``market = site || node``, renames, NaN -> null) and one
    ``dropna``. ``keep`` names extra columns (e.g. an input ordinal) to carry.
    """
    df = raw.select(
        F.col(date_col).alias("date"),
        F.concat(F.col(site_col).cast(T.StringType()), F.col(node_col)).alias("market"),
        nan_to_null(F.col(load_col).cast(T.DoubleType())).alias("value"),
        *keep)
    return drop_missing(df)


def to_panel(clean: DataFrame, date_format: str | None = None,
             keep: tuple[str, ...] = (), on_bad_date: str = "raise") -> DataFrame:
    """``(date, market, value)`` -> ``(code, dt, Y)`` with ``dt`` a date.

    A malformed date is an error; with ``on_bad_date="null"`` its row is left
    out (:func:`count_bad_dates` says how many there are).
    """
    panel = clean.select(F.col("market").alias("code"),
                         parse_date("date", date_format, on_bad_date).alias("dt"),
                         F.col("value").alias("Y"), *keep)
    return panel.where(F.col("dt").isNotNull()) if on_bad_date == "null" else panel


def count_bad_dates(clean: DataFrame, date_format: str | None = None) -> DataFrame:
    """One row: ``n_rows`` and ``n_bad_dates`` of a cleaned table."""
    bad = parse_date("date", date_format, "null").isNull() & F.col("date").isNotNull()
    return clean.agg(F.count(F.lit(1)).alias("n_rows"),
                     F.count(F.when(bad, F.lit(1))).alias("n_bad_dates"))


def aggregate_panel(panel: DataFrame, decimals: int | None = None) -> DataFrame:
    """Sum ``Y`` per (code, dt): one row per series and date.

    The aggregate is split by Spark into a map-side partial sum and a final
    sum, so a hot code is combined before the shuffle. ``decimals`` rounds
    the sum (use 2 for amounts in cents to make the sum order-independent).
    """
    total = F.sum("Y")
    if decimals is not None:
        total = F.round(total, decimals)
    return panel.groupBy("code", "dt").agg(total.alias("Y"))


def build_panel(raw: DataFrame, date_format: str | None = None,
                aggregate: bool = False, decimals: int | None = None,
                date_col: str = "time_key", site_col: str = "sites",
                node_col: str = "node_desc", load_col: str = "ds_load",
                keep: tuple[str, ...] = (), on_bad_date: str = "raise") -> DataFrame:
    """Raw measurement table -> panel ``(code, dt, Y)``."""
    clean = clean_measurements(raw, date_col, site_col, node_col, load_col, keep)
    panel = to_panel(clean, date_format, keep, on_bad_date)
    return aggregate_panel(panel, decimals) if aggregate else panel


def distinct_codes(panel: DataFrame) -> DataFrame:
    return panel.select("code").distinct()


def codes_in_order(rows: DataFrame, ordinal: str = ORDINAL, key: str = "code") -> DataFrame:
    """(key, place): the distinct keys, numbered from 0 by their first appearance.

    ``ordinal`` sorts the rows (see :func:`panelcast.sources.readers.with_input_ordinal`).
    Keys are combined before the shuffle; the written sort numbers them within
    its partitions, and the counts of the partitions before shift the numbers,
    so nothing is numbered by one task.
    """
    slot = F.col("_slot")
    first = rows.groupBy(key).agg(F.min(ordinal).alias("_first"))
    ranked = materialize(first.orderBy("_first").withColumn("_slot", F.monotonically_increasing_id())
                         .select(key, F.shiftright(slot, 33).alias("_part"),
                                 slot.bitwiseAND((1 << 33) - 1).alias("_row")), "codes-in-order")
    # One row per partition of the sort, whatever the number of keys.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return ranked.join(shifts, "_part").select(key, (F.col("_row") + F.col("_shift")).alias("place"))


def filter_code(panel: DataFrame, code: str) -> DataFrame:
    """Rows of one series; the equality predicate reaches the scan when possible."""
    return panel.where(F.col("code") == F.lit(code))


# Tasks that each keep their own first ``k`` rows before the final merge.
TOP_K_BUCKETS = 64


def top_k_rows(df: DataFrame, k: int, by: list[str], buckets: int = TOP_K_BUCKETS) -> DataFrame:
    """The first ``k`` rows in ascending ``by`` order, exactly.

    Input partitions are folded into ``buckets`` groups and each group keeps
    its first ``k`` rows (limited before the shuffle as well, see
    ``WindowGroupLimit``), so the one task of the final ordered limit reads
    ``buckets * k`` rows at most, however large the input. For a ``k`` above
    Spark's ``windowGroupLimitThreshold`` use :func:`panelcast.operators.topk.top_k_rows`,
    which moves only the answer but scans the frame when it is called.
    """
    group = Window.partitionBy("_b").orderBy(*by)
    kept = (df.withColumn("_b", F.spark_partition_id() % buckets)
            .withColumn("_r", F.row_number().over(group)).where(F.col("_r") <= k).drop("_b", "_r"))
    return kept.orderBy(*by).limit(k)
