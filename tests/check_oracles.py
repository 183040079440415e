"""Runs registered queries beside their SQL and reports every difference.

Usage: python tests/check_oracles.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "to_integral_value"):
        return int(value) if value == value.to_integral_value() else float(value)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(normal(row[i]) for i in order) for row in rows), key=repr)


def differences(spark, con, sf_dir: str, query, sql: str) -> str | None:
    df = query(spark, sf_dir)
    left_names, left = table(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    right_names, right = table([d[0] for d in result.description], result.fetchall())
    if left_names != right_names:
        return f"columns {left_names} != {right_names}"
    if left != right:
        only_left = [r for r in left if r not in set(right)][:3]
        only_right = [r for r in right if r not in set(left)][:3]
        return f"{len(left)} rows != {len(right)} rows; only here {only_left}; only in SQL {only_right}"
    return None if left else "empty result"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from archidex.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    sqls = oracle_sql()
    for name, query in queries().items():
        if args and name not in args:
            continue
        started = time.time()
        try:
            if name not in sqls:
                print(f"rows {name} {query(spark, sf_dir).count()} (no SQL) {time.time() - started:.2f}s", flush=True)
                continue
            problem = differences(spark, con, sf_dir, query, sqls[name])
        except Exception as error:  # noqa: BLE001 - a report of all queries is wanted
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - started:.2f}s {problem or ''}", flush=True)
    print(f"{bad} differences")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
