"""The registered queries of this subpackage and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import brown_lm, language_id, packing, runs, sql, toxicity
from .decontaminate import find_benchmark
from .frames import remainder
from .licenses import find_licenses
from .ngram_join import join_ngrams
from .prefix_trie import NODE, end_digests, placed, prefix_trie, with_shared_heads
from .quality import BASE, apply_policy, ledger
from .quotes import link_quotes, with_quotes
from .raking import mixture
from .substring_dedup import find_repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(run):
        QUERIES[name] = lambda spark, sf_dir: run(configure(spark), sf_dir)
        if oracle:
            SQL[name] = oracle
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_ngram_jaccard_join", sql.NGRAM_JOIN)
def ngram_jaccard_join(spark, sf):
    return join_ngrams(table(spark, sf, "documents"), n=3, percent=90)


@query("op2_language_id")
def language_of_documents(spark, sf):
    docs = table(spark, sf, "documents")
    model = language_id.learn(docs.where(remainder(4) != 2).select("text", "lang"))
    found = language_id.label(docs, model)
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "n_letter_words", F.size("spans").alias("n_spans"))


@query("op3_brown_lm")
def brown_scores(spark, sf):
    docs = table(spark, sf, "documents")
    model, rare = brown_lm.learn(docs.where(remainder(7) != 2))
    return brown_lm.score(docs, model, rare, remainder(7) == 2)


@query("op4_benchmark_decontamination", sql.DECONTAMINATION)
def benchmark_decontamination(spark, sf):
    return find_benchmark(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("items")


@query("op5_quotation_linking")
def quotation_linking(spark, sf):
    """Conversations as mail, in which messages quote those before them."""
    linked = link_quotes(with_quotes(table(spark, sf, "conversations")))
    return linked.select("conv_id", "turn", "role", "quote_levels", "n_linked", "n_unlinked", "reply_conv", "reply_turn", "thread_conv", "thread_turn", "depth", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op6_license_scan")
def license_scan(spark, sf):
    return find_licenses(table(spark, sf, "documents"))


@query("op7_mixing")
def mixing(spark, sf):
    return mixture(table(spark, sf, "documents"))


@query("op8_quality_rules", sql.QUALITY)
def quality_rules(spark, sf):
    rows = ledger(table(spark, sf, "documents"))
    return apply_policy(rows.withColumn("base_failed", F.col("failed_bits").bitwiseAND(F.lit(BASE).cast("long")) != 0), "v3")


@query("op9_substring_dedup", sql.SUBSTRING_DEDUP)
def substring_dedup(spark, sf):
    return find_repeats(table(spark, sf, "documents"))


@query("op10_toxicity")
def toxic_passages(spark, sf):
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").select("doc_id", "toxic").where(remainder(5) != 0)
    model = toxicity.learn(docs, labels)
    found = toxicity.score(docs, model)
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted", "n_words", F.size("passages").alias("n_passages"))


@query("op11_periodic_runs")
def periodic_runs(spark, sf):
    found = runs.find_runs(table(spark, sf, "documents"), change=runs.echoed)
    # Of equal lengths the smallest start, then period: the first in the order of `runs`.
    longest = F.array_max("runs.length")
    top = F.get(F.filter("runs", lambda r: r["length"] == longest), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
        F.floor(1000 * top["length"] / top["period"]).cast("long").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_prefix_trie", sql.PREFIX_TRIE)
def conversation_trie(spark, sf):
    """No conversation ends at a node without a digest: it gets that of the empty string."""
    trie = prefix_trie(*with_shared_heads(placed(table(spark, sf, "conversations"))))
    nodes = trie.nodes.join(end_digests(trie.ends), list(NODE), "left")
    digest = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest)


@query("op13_best_fit_packing")
def best_fit_packing(spark, sf):
    import public_tokenizers

    vocabulary = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()
    return packing.pack(packing.pieces(table(spark, sf, "documents"), vocabulary)).drop("row")
