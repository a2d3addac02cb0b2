"""From raw documents to a training mixture, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of documents. `run` writes what a stage returns into the shared folder and reads it
again for the next, so a lost executor costs no more than the stage it worked on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.decontaminate import remove_benchmark
from rowloom.llm.frames import cut
from rowloom.llm.language_id import keep_known, learn
from rowloom.llm.ngram_join import join_ngrams
from rowloom.llm.raking import sample
from rowloom.llm.substring_dedup import remove_repeats
from rowloom.session import configure

#: Near-duplicates share 80 % of their five-word shingles.
SHINGLE, SIMILAR = 5, 80
#: A text stays if some language has this share of its words.
LEAST_SHARE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in no known language. The model learns from the rows' own lang;
    where no row has one, nothing can be told and all rows stay."""
    model = learn(docs.select("text", "lang"))
    return keep_known(docs, model, LEAST_SHARE) if model.languages else docs


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest doc_id, of equal
    ones any, rows without doc_id last. Rows that share a doc_id are joined only if their
    texts are alike. Rows without words all stay."""
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return _join_rows(docs)
    groups = cut(join_ngrams(docs, SHINGLE, SIMILAR).select(F.col("doc_id").alias("id"), "component_id"), "groups")
    copies = groups.where("id <> component_id").select("id")
    return docs.join(copies, docs["doc_id"] == copies["id"], "left_anti")


def _join_rows(docs: DataFrame) -> DataFrame:
    """The same where doc_id does not tell rows apart: doc_id and text do."""
    key = F.xxhash64("doc_id", "text")
    groups = cut(join_ngrams(docs.select(key.alias("doc_id"), "text"), SHINGLE, SIMILAR).select(F.col("doc_id").alias("key"), "component_id", "n_links"), "groups")
    linked = groups.where("n_links > 0")
    named = linked.select("key", "component_id").distinct().join(docs.select(key.alias("key"), "doc_id").distinct(), "key")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))).alias("first"))
    stays = cut(first.select(F.col("first.key").alias("key")), "stays")
    copies = linked.select("key").distinct().join(stays, "key", "left_anti")
    marked = docs.withColumn("__key", key)
    kept = marked.join(copies, marked["__key"] == copies["key"], "left_anti")
    once = kept.join(stays, kept["__key"] == stays["key"], "left_anti")
    one = kept.join(stays, kept["__key"] == stays["key"], "left_semi").dropDuplicates(["__key"])
    return once.unionByName(one).select(docs.columns)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the words of 35-word windows that stand in more than one place."""
    return remove_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold benchmark text."""
    return remove_benchmark(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"), remove="documents")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, drawn so that sources, languages and topics are nearer to even."""
    return sample(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", join_near_copies),
    ("substring_dedup", remove_repeated_passages),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
]

#: The language stage has a trained model in it, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
