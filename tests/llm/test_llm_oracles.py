"""The corpus queries that SQL can express match DuckDB on whole tables."""

import pytest

from conftest import SF_MID, SF_SMALL
from oracle_compare import compare, duckdb_con
from panelcast.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_query_matches_oracle(spark, name, sf):
    assert not compare(QUERIES[name](spark, sf), duckdb_con(sf), ORACLES[name])


def test_entry_adds_them():
    import __spark_entry__ as entry

    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
