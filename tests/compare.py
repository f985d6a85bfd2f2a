"""Run queries and their SQL side by side: python tests/compare.py [sf] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows with columns in name order, sorted."""
    frame = frame[sorted(frame.columns)]
    rows = [tuple(None if pd.isna(v) else v for v in row) for row in frame.itertuples(index=False)]
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


def mismatch(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """What differs, or None."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"
    kinds = [
        (c, str(spark_frame[c].dtype), str(sql_frame[c].dtype))
        for c in spark_frame.columns
        if str(spark_frame[c].dtype) != str(sql_frame[c].dtype)
    ]
    if kinds:
        return f"types {kinds}"
    if len(spark_frame) != len(sql_frame):
        return f"{len(spark_frame)} rows != {len(sql_frame)} rows"
    for a, b in zip(canonical(spark_frame), canonical(sql_frame)):
        if a != b:
            return f"{str(a)[:400]}\n   != {str(b)[:400]}"
    return None


def main() -> None:
    from twinline.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = get_session("compare", "local[8]", 8, "12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = database(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            mine = fn(spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in sqls:
                print(f"no SQL {name:20s} {len(mine):7d} rows {took:6.2f}s")
                continue
            start = time.time()
            other = con.execute(sqls[name]).df()
            problem = mismatch(mine, other)
            print(f"{'ok ' if problem is None else 'BAD'} {name:20s} {len(mine):7d} rows {took:6.2f}s sql {time.time() - start:5.2f}s")
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
            print("BAD", name)
        if problem is not None:
            bad += 1
            print("  ", problem)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
