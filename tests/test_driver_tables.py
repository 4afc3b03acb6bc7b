"""Panel sizes over the provided tables, and plan-level scale properties."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from panelcast.functions.calendar_features import CALENDAR_COLUMNS, add_calendar_features
from panelcast.operators import lags
from panelcast.plans import panels
from panelcast.plans.joins import dimension_left_join

FEATURES = ["Y", *CALENDAR_COLUMNS]


@pytest.mark.parametrize("sf,codes,rows,lag_rows", [
    (SF_SMALL, 93, 1495, 1031),
    (SF_MID, 125, 14589, 13964),
])
def test_panel_a_sizes(spark, sf, codes, rows, lag_rows):
    panel = panels.panel_a(spark, sf)
    assert panel.count() == rows
    assert panel.select("code").distinct().count() == codes
    assert lags.lag_frame(add_calendar_features(panel), 5, columns=FEATURES).count() == lag_rows


@pytest.mark.parametrize("sf,codes,rows,short", [
    (SF_SMALL, 75, 792, 5),
    (SF_MID, 750, 8045, 32),
])
def test_panel_b_sizes(spark, sf, codes, rows, short):
    panel = panels.panel_b(spark, sf)
    per_code = panel.groupBy("code").count()
    assert panel.count() == rows
    assert per_code.count() == codes
    assert per_code.where(F.col("count") < 7).count() == short
    # Lag rows: sum of n - N over series with n >= N + 2.
    want = per_code.where(F.col("count") >= 7).select(F.sum(F.col("count") - 5)).first()[0]
    assert lags.lag_frame(add_calendar_features(panel), 5, columns=FEATURES).count() == want


def test_lag_frame_is_one_exchange(spark, capsys):
    panel = spark.createDataFrame([("a", 1, 1.0)], "code string, dt int, Y double")
    lags.lag_frame(panel, 5).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Window [") == 1


def test_dimension_left_join_with_hot_key(spark):
    # One fact key holds a third of the rows; two dimension rows have no facts.
    dim = spark.createDataFrame([(k, f"d{k}") for k in range(10)], "k int, name string")
    facts = [(0, float(i)) for i in range(300)] + [(k % 8, float(k)) for k in range(600)]
    fact = spark.createDataFrame(facts, "fk int, v double")
    got = dimension_left_join(dim, fact, "k", "fk").select("k", "name", "v")
    want = dim.join(fact, dim.k == fact.fk, "left").select("k", "name", "v")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert got.where(F.col("v").isNull()).count() == 2


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(min_value=1, max_value=12), min_size=1, max_size=6),
       st.integers(min_value=1, max_value=4))
def test_lag_row_count_property(spark, lengths, n):
    rows = [(f"c{i}", d, float(d * (i + 1))) for i, m in enumerate(lengths) for d in range(m)]
    panel = spark.createDataFrame(rows, "code string, dt int, Y double")
    want = sum(m - n for m in lengths if m >= n + 2)
    assert lags.lag_frame(panel, n).count() == want


def _jobs_started(spark, group, build):
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        build()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(group))


def test_building_a_query_runs_nothing_but_footers(spark):
    from panelcast.plans.registry import queries
    for name in ("lag_frame_backward", "label_within_30d", "topk_value", "zscore", "mape_by_code",
                 "ratio_extrapolate", "clean_dropna", "panel_sql_view"):
        # One job per table read, for the parquet footers.
        assert _jobs_started(spark, f"build-{name}", lambda: queries()[name](spark, SF_SMALL)) <= 3, name


def test_split_reads_the_written_model_frame(spark, capsys):
    from panelcast.plans.registry import queries
    queries()["time_split_train"](spark, SF_SMALL).explain()
    assert "Window" not in capsys.readouterr().out
