"""Run queries and their DuckDB statements side by side.

``python -m tests.compare <data folder> [key ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime as dt
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, key, query, sql, sf_dir) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    have = bag(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = bag(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if have != want:
        extra, missing = have - want, want - have
        return False, (
            f"{sum(have.values())} rows, expected {sum(want.values())}; extra {sum(extra.values())}, "
            f"missing {sum(missing.values())}\n   extra   {list(extra)[:2]}\n   missing {list(missing)[:2]}"
        )
    return sum(have.values()) > 0, f"{sum(have.values())} rows"


def main() -> int:
    import __spark_entry__ as e
    from sentrel.session import build_session

    sf_dir, *keys = sys.argv[1:]
    spark = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = connect(sf_dir), e.oracle_sql(), 0
    for key, query in e.queries().items():
        if keys and key not in keys:
            continue
        start = time.time()
        try:
            if key in oracle:
                ok, note = compare(spark, con, key, query, oracle[key], sf_dir)
            else:
                n = query(spark, sf_dir).count()
                ok, note = n > 0, f"{n} rows (no SQL)"
        except Exception as error:  # noqa: BLE001 - a report of all keys is wanted
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", key, note, f"{time.time() - start:.1f}s", flush=True)
    print("failed:", bad, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
