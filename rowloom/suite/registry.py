"""Named queries over the given tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure, fresh_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(configure(spark), sf_dir)

        QUERIES[name] = configured
        if sql:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_written: dict[tuple, str] = {}


def written(spark: SparkSession, sf_dir: str, label: str, write: Callable[[str], None]) -> str:
    """Path of files derived from the tables, written once per session into the
    shared folder, for queries that read files of other formats."""
    where = (spark.sparkContext.applicationId, sf_dir, label)
    if where not in _written:
        path = fresh_path(spark, label)
        write(path)
        _written[where] = path
    return _written[where]
