"""Streaming runs over the tables, to completion and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.drill import key_path
from ..operators.profile import json_schema
from ..recipes import Delete, Fill, FormatTimestamp, Rename, where
from ..session import fresh_path
from ..streaming.recipe import stream_drill, stream_recipe, stream_recipe_over_lines
from ..streaming.schema import SchemaState, refine_schema
from .registry import query, table, written


def stream_of(spark, sf, name: str) -> DataFrame:
    """The table as a stream, be it a file or a folder of files: a pattern may name either."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf.rstrip('/')}/{name}.parque[t]")


def finished(spark, frame: DataFrame, label: str) -> DataFrame:
    out, checkpoint = fresh_path(spark, label), fresh_path(spark, f"{label}-checkpoint")
    run = frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query(
    "stream_recipe",
    """select event_id as id, strftime(ts, '%Y-%m-%d %H:00') as ts, user_id, 'x' as event_type, value
       from events where value > 20 and lower(event_type) in ('click') """,
)
def recipe(spark, sf):
    actions = [
        where("value", "GreaterThan", "20", "Number"), where("event_type", "Equals", "CLICK"), Rename("event_id", "id"),
        Fill("event_type", "x"), FormatTimestamp("ts", "yyyy-MM-dd HH:00"), Delete("props"),
    ]
    return finished(spark, stream_recipe(stream_of(spark, sf, "events"), actions), "stream-recipe")


@query("stream_recipe_lines", "select json_extract_string(props, '$.k') as key from events where cast(json_extract_string(props, '$.k') as int) >= 50")
def recipe_lines(spark, sf):
    lines = stream_of(spark, sf, "events").select(F.col("props").alias("line"))
    actions = [where("k", "GreaterThanOrEqual", "50", "Number"), Rename("k", "key")]
    return finished(spark, stream_recipe_over_lines(lines, actions, ["k"]), "stream-lines")


@query("stream_drill", """select cast(event_id as varchar) as "#", json_extract_string(props, '$.k') as k from events""")
def drilled(spark, sf):
    lines = stream_of(spark, sf, "events").select("event_id", F.col("props").alias("line"))
    return finished(spark, stream_drill(lines, key_path("k"), "event_id", ["k"]), "stream-drill")


@query(
    "stream_schema",
    """select 'id' as name, 'WholeNumber' as type, 'number' as label, false as nullable from events group by 1
       union all select event_type, 'WholeNumber', 'number', true from events group by 1""",
)
def schema(spark, sf):
    """Events in one file per kind, each with a key of its own, so that every batch of
    the stream refines the schema of those before."""

    def write(path: str) -> None:
        value = F.concat(F.lit('{"id":'), "event_id", F.lit(',"'), "event_type", F.lit('":'), "user_id", F.lit("}"))
        table(spark, sf, "events").select("event_type", value.alias("line")).repartition("event_type").write.partitionBy("event_type").parquet(path)

    path = written(spark, sf, "events-by-kind", write)
    state = SchemaState(spark, fresh_path(spark, "stream-schema"))
    lines = spark.readStream.schema("line string").option("maxFilesPerTrigger", 1).parquet(path).select("line")
    refine_schema(lines, state, fresh_path(spark, "stream-schema-checkpoint")).awaitTermination()
    return json_schema(state.summary(state.last())).drop("first")
