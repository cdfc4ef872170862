"""Run registered queries beside their SQL twins: python tests/compare.py [folder] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or v != v:
            return None
        if hasattr(v, "item"):
            v = v.item()
        return float(v) + 0.0 if isinstance(v, (int, float)) else str(v)

    columns = sorted(df.columns)
    rows = [tuple(cell(v) for v in r) for r in df[columns].astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def difference(spark_df, con, sql: str) -> str | None:
    """None if both results agree, else a short description of the first difference."""
    left, right = spark_df.toPandas(), con.sql(sql).df()
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    a, b = normal(left), normal(right)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, first {wrong[0]}" if wrong else None


if __name__ == "__main__":
    import __spark_entry__ as entry

    from lossgrid.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = connect(folder), entry.oracle_sql()
    for name, f in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            df = f(spark, folder)
            if name in oracles:
                result = difference(df, con, oracles[name]) or "ok"
            else:
                result = f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            result = f"FAILED {type(e).__name__}: {str(e).splitlines()[0][:300]}"
        print(f"{time.time() - t:6.1f}s {name}: {result[:400]}", flush=True)
