"""Registry of queries over the provided tables, each with its DuckDB oracle.

Every query reads whole tables from ``sf_dir`` and returns a lazy DataFrame.
Computed columns carry the same aliases as the oracle SQL. Values that go
through transcendental functions are rounded on both sides so that the
one-ulp differences between math libraries do not matter. Queries without
an oracle (model training) are checked on row counts and by the unit tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _load() -> None:
    # Importing the query modules fills QUERIES / ORACLES.
    from panelcast.plans import queries_forecast, queries_ml, queries_panel, queries_rows  # noqa: F401


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History plus ratio forecast with calendar and lag features (no training)."""
    from panelcast.plans.queries_forecast import history_plus_forecast

    return history_plus_forecast(spark, sf_dir)
