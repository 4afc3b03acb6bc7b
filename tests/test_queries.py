"""Every registered query matches DuckDB on the smallest tables. Plus the driver entry point."""

import importlib.util
import os

import pytest

from conftest import ROOT, SF_MID, SF_SMALL
from oracle_compare import compare, duckdb_con
from panelcast.plans.registry import oracle_sql, queries

ORACLES = oracle_sql()
QUERIES = queries()


@pytest.fixture(scope="module")
def con():
    return duckdb_con(SF_SMALL)


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(QUERIES)
    assert len(QUERIES) >= 53


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    problems = compare(QUERIES[name](spark, SF_SMALL), con, ORACLES[name])
    assert not problems, problems


def test_every_oracle_returns_rows():
    mid = duckdb_con(SF_MID)
    for name, sql in ORACLES.items():
        assert mid.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0] > 0, name
    # Those that leave something out do so, and not everything.
    for name, of in (("outlier_filter", "lag_frame_backward"), ("topk_value", "csv_source"),
                     ("filter_code", "panel_sum")):
        n, all_ = (mid.execute(f"SELECT count(*) FROM ({ORACLES[x]})").fetchone()[0] for x in (name, of))
        assert 0 < n < all_, name


def test_entry(spark):
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    assert df.count() > 0
    assert "Y_000_day_before" in df.columns and "code" in df.columns
    assert set(mod.oracle_sql()) <= set(mod.queries())
