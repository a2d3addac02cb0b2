"""Run the registered queries next to their SQL on DuckDB and compare whole results.

    python tests/compare.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import collections
import datetime
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return collections.Counter(tuple(plain(row[i]) for i in order) for row in rows)


def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def difference(spark, connection, run, sql, sf_dir):
    """None if both give the same columns and rows, else what differs."""
    frame = run(spark, sf_dir)
    mine = bag(frame.columns, (tuple(row) for row in frame.collect()))
    if sql is None:
        return None if mine else "no rows"
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {frame.columns} against {names}"
    theirs = bag(names, result.fetchall())
    if mine == theirs:
        return None
    extra, missing = mine - theirs, theirs - mine
    return f"{sum(mine.values())} rows against {sum(theirs.values())}; only here {list(extra)[:3]}; only there {list(missing)[:3]}"


def main() -> None:
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql, bad = duck(sf_dir), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            found = difference(spark, connection, run, sql.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            traceback.print_exc(limit=3)
            found = f"{type(error).__name__}: {str(error)[:500]}"
        bad += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {name} {time.time() - start:.2f}s {found or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
