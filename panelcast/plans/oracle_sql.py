"""DuckDB SQL builders mirroring the Spark queries (used by the oracle check)."""

from __future__ import annotations

from panelcast.functions.calendar_features import CALENDAR_COLUMNS
from panelcast.operators.lags import lag_name

CALENDAR_SQL = {
    "year": "year(dt)",
    "month": "month(dt)",
    "day": "day(dt)",
    "week": "weekofyear(dt)",
    "weekday": "isodow(dt)",
    "isoweekday": "isodow(dt)",
    "weekofyear": "CAST(strftime(dt, '%W') AS INTEGER)",
    "dayofyear": "dayofyear(dt)",
    "dayofmonth": "dayofmonth(dt)",
    "days2": "(year(dt) - 2018) + (month(dt) - 1) * 30 + day(dt)",
}


def calendar_select(src: str, extra: str = "code, dt, Y") -> str:
    cols = ", ".join(f"CAST({CALENDAR_SQL[c]} AS INTEGER) AS {c}" for c in CALENDAR_COLUMNS)
    return f"SELECT {extra}, {cols} FROM {src}"


def lag_select(src: str, value_cols: list[str], n: int = 5, mode: str = "backward",
               drop_null: bool = True, key: str = "code", order: str = "dt") -> str:
    fn = "lag" if mode == "backward" else "lead"
    w = f"OVER (PARTITION BY {key} ORDER BY {order})"
    items = {}
    for c in value_cols:
        for i in range(n + 1):
            v = c if i == 0 else f"{fn}({c}, {i}) {w}"
            items[lag_name(c, i)] = f"CAST({v} AS DOUBLE)"
    names = sorted(items)
    inner = (f"SELECT {key}, dt, " + ", ".join(f"{items[k]} AS {k}" for k in names)
             + f", count(*) OVER (PARTITION BY {key}) AS _n FROM {src}")
    where = f"_n >= {n + 2}"
    if drop_null:
        where += "".join(f" AND {k} IS NOT NULL" for k in names)
    return f"SELECT {key}, dt, {', '.join(names)} FROM ({inner}) WHERE {where}", names


def with_ctes(ctes: dict[str, str], body: str) -> str:
    parts = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes.items())
    return f"WITH {parts}\n{body}"
