"""The first k rows of a large frame by slices of the order, without sorting the frame.

The row at place k is located column by column: values of a bounded sample
cut the order into slices, one aggregate (combined before the shuffle) counts
them, and the slice that holds the place is cut again until few enough
distinct values are left to be counted one by one. The answer is then a filter that reaches the scan:
all rows before the boundary, and as many rows equal to it as are missing.
Only rows of the answer are ever sorted or moved.

The frame is scanned a few times (more for more rows, with the logarithm to
the base of the sample size); give it a table or a written frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sampled values that cut the order, and distinct values that are counted one by one.
CUTS = 256


def _below(col: Column, value) -> Column:
    """Sorted before ``value`` in ascending order (nulls first); false for null."""
    return F.lit(False) if value is None else col.isNull() | (col < F.lit(value))


def _same(col: Column, value) -> Column:
    return col.isNull() if value is None else col.eqNullSafe(F.lit(value))


def boundary_value(rows: DataFrame, name: str, place: int):
    """(value, before, same): the ``place``-th value of a column, and how many rows lie
    before it and have it.

    There must be at least ``place`` rows. Nulls come first and NaN last.
    """
    col = F.col(f"`{name}`")
    nulls = rows.where(col.isNull()).count()
    if place <= nulls:
        return None, 0, nulls
    region, before = rows.where(col.isNotNull()), nulls
    while True:
        drawn = region.select(col.alias("v"), F.rand(7).alias("r")).orderBy("r").limit(CUTS).select("v").distinct()
        cuts = sorted((r.v for r in drawn.collect()), key=lambda v: (v != v, v))  # at most CUTS values
        # Slice 2 i holds the values between two cuts, slice 2 i + 1 the cut itself.
        at = F.lit(2 * len(cuts))
        tree = _cut_tree(col, cuts, 0, len(cuts)) if cuts else at
        counts = {r.s: r.n for r in region.groupBy(tree.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for s in sorted(counts):
            if before + counts[s] >= place:
                break
            before += counts[s]
        if s % 2:
            return cuts[s // 2], before, counts[s]
        if s // 2 > 0:
            region = region.where(col > F.lit(cuts[s // 2 - 1]))
        if s // 2 < len(cuts):
            region = region.where(col < F.lit(cuts[s // 2]))


def _cut_tree(col: Column, cuts: list, first: int, last: int) -> Column:
    """The slice of a value, by halving: an expression as deep as the logarithm of the cuts."""
    if first == last:
        return F.lit(2 * first)
    mid = (first + last) // 2
    return (F.when(col < F.lit(cuts[mid]), _cut_tree(col, cuts, first, mid))
            .when(col == F.lit(cuts[mid]), F.lit(2 * mid + 1)).otherwise(_cut_tree(col, cuts, mid + 1, last)))


def top_k_rows(df: DataFrame, k: int, by: list[str]) -> DataFrame:
    """The first ``k`` rows in ascending ``by`` order (nulls first), exactly.

    Of rows that are equal in all ``by`` columns any may be taken. The result is
    sorted; fewer than ``k`` rows are all returned.
    """
    if k < 1:
        return df.limit(0)
    if df.limit(k).count() < k:
        return df.orderBy(*by)
    region, need, values = df, k, []
    for name in by:
        value, before, same = boundary_value(region, name, need)
        values.append(value)
        region, need = region.where(_same(F.col(f"`{name}`"), value)), need - before
        if need == same:
            break  # all rows with these values belong to the answer
    first, equal = F.lit(False), F.lit(True)
    for name, value in reversed(list(zip(by, values))):
        col = F.col(f"`{name}`")
        first = _below(col, value) | (_same(col, value) & first)
    for name, value in zip(by, values):
        equal = equal & _same(F.col(f"`{name}`"), value)
    # Rows equal to the boundary are interchangeable in the order, so a plain limit takes them.
    return df.where(first).unionByName(df.where(equal).limit(need)).orderBy(*by)
