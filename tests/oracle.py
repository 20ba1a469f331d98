"""Compare a Spark result with the same in DuckDB, rows in any order."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def connection(folder: str = DATA):
    c = duckdb.connect()
    for f in sorted(Path(folder).glob("*.parquet")):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}/*.parquet'" if f.is_dir() else f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def rows(df):
    """Rows with columns by name, as sorted tuples of text; doubles to nine places."""

    def told(v):
        if v is None or v is pd.NA or v != v:
            return "~"
        if isinstance(v, float) or getattr(getattr(v, "dtype", None), "kind", "") == "f":
            return repr(round(float(v), 9))
        return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)

    df = df[sorted(df.columns)]
    whole = [c for c in df if df[c].dtype.kind == "f" and df[c].isna().any() and (df[c].dropna() % 1 == 0).all()]
    for c in whole:  # a null among whole numbers makes pandas use doubles
        df = df.assign(**{c: df[c].astype("Int64").astype(object).where(df[c].notna(), None)})
    return list(df.columns), sorted(tuple(map(told, r)) for r in df.itertuples(index=False, name=None))
