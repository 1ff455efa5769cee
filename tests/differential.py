"""Compare registered queries with their SQL: python -m tests.differential [sf_dir] [names...]."""

from __future__ import annotations

import os
import sys

import duckdb
import pandas as pd


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    plain = lambda v: None if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)) else (round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v))
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=str)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    """Empty if both sides agree, else what differs."""
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"{name}: columns {sorted(got.columns)} against {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a == b:
        return "" if a else f"{name}: no rows"
    odd = next(((x, y) for x, y in zip(a, b) if x != y), (a[-1:], b[-1:]))
    return f"{name}: {len(a)} and {len(b)} rows; {str(odd[0])[:400]} against {str(odd[1])[:400]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from tamarack.plans import queries as core

    sf, names = (sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"), sys.argv[2:] or list(core.QUERIES)
    spark = SparkSession.builder.master("local[6]").config("spark.sql.shuffle.partitions", "6").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con = views(sf)
    for n in names:
        try:
            said = compare(spark, con, n, core.QUERIES[n], core.ORACLES[n], sf) if n in core.ORACLES else ("" if core.QUERIES[n](spark, sf).count() else "no rows")
        except Exception as e:  # noqa: BLE001
            said = f"{n}: {type(e).__name__} {str(e)[:500]}"
        print("ok  " if not said else "FAIL", n, said, flush=True)
