"""A query's rows against the rows of its SQL in DuckDB, without regard to order."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

from gamelode.plans.bindings import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(x) -> str:
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)) or x is pd.NA:
        return "null"
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    if isinstance(x, int) or type(x).__name__.startswith(("int", "uint")):
        return str(int(x))
    if isinstance(x, float) or type(x).__name__ in ("float64", "float32", "Decimal"):
        return str(int(x)) if float(x) == int(x) else f"{float(x):.9g}"
    return str(x)


def rows(frame: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(frame.columns)
    return names, sorted(tuple(map(_cell, r)) for r in frame[names].itertuples(index=False, name=None))


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str:
    a, b = rows(got), rows(want)
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if a[1] == b[1]:
        return ""
    extra, missing = [x for x in a[1] if x not in set(b[1])][:3], [x for x in b[1] if x not in set(a[1])][:3]
    return f"{len(a[1])} and {len(b[1])} rows; only here {extra}; only in SQL {missing}"
