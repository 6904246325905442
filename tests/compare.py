"""Order-free comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    kind = getattr(getattr(v, "dtype", None), "kind", "")
    if isinstance(v, float) or kind == "f":
        v = float(v)
        if math.isnan(v):
            return None
        v = round(v, 9)
        return int(v) if v == int(v) else v
    if kind in ("i", "u"):
        return int(v)
    return bool(v) if kind == "b" else v


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr(tuple(cell(v) for v in r)) for r in df.itertuples(index=False, name=None))


def duck(sf_dir: str, sql: str) -> pd.DataFrame:
    with duckdb.connect() as c:
        for path in Path(sf_dir).glob("*.parquet"):
            c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        return c.execute(sql).df()


def assert_same(spark_df, sf_dir: str, sql: str) -> None:
    got, want = spark_df.toPandas(), duck(sf_dir, sql)
    assert sorted(got.columns) == sorted(want.columns)
    got, want = rows(got), rows(want)
    assert len(got) == len(want)
    different = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not different, different[:3]
