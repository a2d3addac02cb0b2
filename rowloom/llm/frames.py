"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, fresh_path


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the library's settings, and Arrow batches of few bytes, so that long
    texts do not make large batches."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark


def texts(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, the text as bytes, and the named columns; nothing else of `docs`."""
    prepared(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), *others)


def named_column(name: str):
    """The column called `name`, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_text(found: DataFrame, docs: DataFrame, text, changed) -> DataFrame:
    """The columns of `docs` again, of its other columns in `row` and the new text; n_chars,
    where there is such a column, follows where the text has changed."""
    columns = []
    for name in docs.columns:
        value = text if name == "text" else F.col("row").getField(name)
        if name == "n_chars":
            value = F.when(changed, F.length(text)).otherwise(value).cast(docs.schema[name].dataType)
        columns.append(value.alias(name))
    return found.select(*columns)


def cut(frame: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read again: lineage ends here, and what was
    computed outlives the executors that computed it."""
    path = fresh_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def remainder(divisor: int):
    """crc32 of the document's id as text, modulo `divisor`."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b): the smallest node reachable.

    Each round every node points to its smallest neighbour or itself, pointers are
    followed twice, and edges are rewritten to what their ends point to. Edges inside
    one component disappear, so the rounds grow with the logarithm of the longest chain.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = cut(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        points = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to"))
        points = cut(points, "points")
        for _ in range(2):
            further = points.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
            points = points.join(further, "to").select("node", F.col("beyond").alias("to"))
        points = cut(points, "points")
        labels = cut(
            labels.join(points.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component")),
            "labels",
        )
        a, b = points.select(F.col("node").alias("a"), F.col("to").alias("to_a")), points.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        moved = edges.join(a, "a").join(b, "b").where("to_a <> to_b")
        edges = cut(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
    return labels
