"""Run registered queries in Spark and their SQL in DuckDB on the same tables and compare all rows.

    python tools/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from tidebar.catalog import ORACLE, QUERIES  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session() -> SparkSession:
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    df = df.map(lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else (
        float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)))
    return df.astype(object).where(df.notna(), None).sort_values(list(df.columns), key=lambda c: c.map(lambda v: (v is None, str(v)))).reset_index(drop=True)


def compare(spark, con, name: str, sf_dir: str) -> str:
    t = time.time()
    mine = QUERIES[name](spark, sf_dir).toPandas()
    spent = time.time() - t
    if name not in ORACLE:
        return f"rows-only {len(mine)} rows {spent:.1f}s"
    t = time.time()
    other = con.execute(ORACLE[name]).df()
    duck_spent = time.time() - t
    if sorted(mine.columns) != sorted(other.columns):
        return f"COLUMNS {sorted(mine.columns)} vs {sorted(other.columns)}"
    if len(mine) != len(other):
        return f"ROWS {len(mine)} vs {len(other)}"
    a, b = normal(mine), normal(other)
    bad = [(c, int((a[c].map(repr) != b[c].map(repr)).sum())) for c in a.columns]
    bad = [x for x in bad if x[1]]
    if bad:
        c = bad[0][0]
        at = (a[c].map(repr) != b[c].map(repr)).idxmax()
        return f"VALUES {bad[:6]} first row {at}: {a.loc[at].to_dict()} vs {b.loc[at].to_dict()}"
    return f"ok {len(mine)} rows {spent:.1f}s (sql {duck_spent:.1f}s)"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark, con, failed = session(), duck(args.sf), 0
    for name in args.names or QUERIES:
        try:
            result = compare(spark, con, name, args.sf)
        except Exception as e:  # report and go on with the next query
            result = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        failed += not result.startswith(("ok", "rows-only"))
        print(f"{name}: {result}", flush=True)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
