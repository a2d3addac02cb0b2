"""A schema that refines itself while a stream is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.profile import csv_summary, json_summary

_SUMMARISE: dict[str, Callable[[DataFrame], DataFrame]] = {"jsonl": json_summary, "csv": csv_summary}


class SchemaState:
    """Merged summary of all batches so far, kept as small parquet tables in a
    shared folder, one per batch, so that a restarted query goes on from there.

    A summary has one row per column; it does not grow with the data. Places of
    first rows only have an order within a batch, so the batch is kept with them.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder.rstrip("/")

    def _path(self, batch: int) -> str:
        return f"{self._folder}/batch-{batch:010d}"

    def summary(self, batch: int) -> DataFrame:
        """Summary of everything up to a batch (see ``operators.profile``)."""
        kept = self._spark.read.parquet(self._path(batch))
        same = F.col("first.batch") == F.col("first_empty.batch")
        return kept.withColumn("first_empty", F.when(same, F.col("first_empty.place"))).withColumn("first", F.col("first.place"))

    def last(self) -> int:
        """Number of the last batch that was merged."""
        parts = self._spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self._folder}/batch-*")
        found = parts.select(F.max(F.regexp_extract("path", r"batch-(\d{10})/[^/]*$", 1))).first()[0]
        if found is None:
            raise ValueError("No batch has been merged yet.")
        return int(found)

    def add(self, part: DataFrame, batch: int) -> None:
        """Merge a batch. Adding the same batch again gives the same table."""

        def placed(place: str) -> Column:
            return F.when(F.col(place).isNotNull(), F.struct(F.lit(batch).alias("batch"), F.col(place).alias("place")))

        merged = part.withColumn("first", placed("first")).withColumn("first_empty", placed("first_empty"))
        if batch > 0:
            merged = self._spark.read.parquet(self._path(batch - 1)).unionByName(merged).groupBy("name").agg(
                F.bit_or("mask").alias("mask"), F.sum("filled").alias("filled"), F.sum("rows").alias("rows"),
                F.min("first").alias("first"), F.min("first_empty").alias("first_empty"),
            )
        merged.coalesce(1).write.mode("overwrite").parquet(self._path(batch))


def refine_schema(stream: DataFrame, state: SchemaState, checkpoint: str, data_format: str = "jsonl", **trigger) -> StreamingQuery:
    """Start a query that merges every batch's summary into ``state``: of JSON
    lines (column ``line``) or, for "csv", of a table of text columns."""
    summarise = _SUMMARISE[data_format]
    writer = stream.writeStream.foreachBatch(lambda batch, number: state.add(summarise(batch), number))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
