"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of (source, language, topic). The weights of the cells
are raked: scaled to the target share of each source, then language, then topic, again
and again until all three hold. Documents are then drawn with calibrated probabilities.
Only cells, never documents, take part in the iterations. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import configure
from .frames import cut
from .quality import words_of

DIMENSIONS, UNKNOWN = ("source", "lang", "topic"), "unknown"
POWER, SHARE, SWEEPS, TOLERANCE = 0.7, 0.5, 30, 1e-6


def topic_of(text: Column) -> Column:
    """The form of a text, which stands in for a topic where there is none: table, contact,
    license, list, prose or empty."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(F.trim(text) == "", "empty").when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("@")), "contact")
        .when(text.rlike("(?i)licen[sc]e"), "license").when(text.rlike(r"(?m)^\s*([-*]|\d+[.)]) "), "list").otherwise("prose")
    )


def cells_of(docs: DataFrame, topic: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with their cell and n_tokens, cells with tokens). Null is the value `unknown`."""
    configure(docs.sparkSession)
    names = [F.coalesce(F.col(d).cast("string"), F.lit(UNKNOWN)).alias(d) for d in ("source", "lang")]
    thin = docs.select("doc_id", *names, (topic_of(F.col("text")) if topic is None else topic).alias("topic"), F.size(words_of(F.col("text"))).cast("long").alias("n_tokens"))
    thin = cut(thin, "cells-of-documents")
    return thin, cut(thin.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")


def tempered(cells: DataFrame, dimension: str, power: float = POWER) -> DataFrame:
    """Default target: the share of each value (value, share), raised to `power`."""
    total = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("n"))
    return total.select("value", F.pow(F.col("n").cast("double"), F.lit(power)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """`cells` with weight, so that the sums of tokens * weight meet the targets.

    Targets are (value, share) for any of source, lang and topic; shares are taken relative
    to those of the values present. A value without a target, or with none above 0, weighs 0.
    The total of tokens stays. Ends when a sweep changes no weight by more than `tolerance`
    of itself, or after `sweeps` sweeps where targets contradict each other."""
    given, tokens = {}, cells.agg(F.sum("tokens").cast("double")).first()[0]
    for dimension, target in targets.items():
        present = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("n")).where("n > 0")
        held = target.groupBy("value").agg(F.sum("share").alias("share")).where("share > 0").join(present, "value").select("value", "share")
        whole = held.agg(F.sum("share")).first()[0]
        given[dimension] = cut(held.select(F.col("value").alias(dimension), (F.col("share") / F.lit(whole or 1.0) * F.lit(tokens or 0.0)).alias("wanted")), "targets")
    state = cells.select(*DIMENSIONS, "tokens", F.lit(1.0).alias("weight"))
    for _ in range(sweeps):
        before = state.withColumn("before", F.col("weight"))
        for dimension, wanted in given.items():
            now = before.groupBy(dimension).agg(F.sum(F.col("tokens") * F.col("weight")).alias("now"))
            factor = now.join(wanted, dimension, "left").select(dimension, F.when(F.col("now") > 0, F.coalesce("wanted", F.lit(0.0)) / F.col("now")).otherwise(F.lit(0.0)).alias("factor"))
            before = before.join(factor, dimension).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        before = cut(before, "raked")
        moved = before.agg(F.max(F.abs(F.col("weight") - F.col("before")) / F.greatest("weight", F.lit(1e-12)))).first()[0]
        state = before.drop("before")
        if moved is None or moved <= tolerance:
            break
    return state


def calibrated(raked: DataFrame, share: float = SHARE) -> DataFrame:
    """Raked cells with probability = least(1, rate * weight), the rate such that `share`
    of all tokens is expected. Where weights are so uneven that cells reach 1, the rest is
    taken from the others in proportion to their weights."""
    rate = 0.0
    for _ in range(20):
        full = F.col("weight") * F.lit(rate) >= 1
        whole, fixed, free = raked.agg(
            F.sum("tokens").cast("double"), F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)).cast("double"), F.coalesce(F.sum(F.when(~full, F.col("tokens") * F.col("weight"))), F.lit(0.0))
        ).first()
        if not whole or not free or share * whole <= fixed:
            break
        further = (share * whole - fixed) / free
        if abs(further - rate) <= 1e-12 * further:
            break
        rate = further
    return raked.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * F.lit(rate)))


def drawn(doc_id: Column, probability: Column, seed: int) -> Column:
    """Whether a document is in: a hash of its id and the seed, as a number in [0, 1), is
    below its probability. The same at every run, however the rows lie."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53)) < probability


def mixture(docs: DataFrame, targets: dict[str, DataFrame] | None = None, share: float = SHARE, seed: int = 17, topic: Column | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source, lang): doc_id, source, lang, topic,
    n_tokens, weight, probability, selected.

    Null source or language is the value `unknown`; null text has no tokens. A cell
    without tokens weighs 0. A row without doc_id is drawn like all
    others without. An empty table gives an empty table."""
    thin, cells = cells_of(docs, topic)
    if targets is None:
        targets = {dimension: tempered(cells, dimension) for dimension in DIMENSIONS}
    weighed = calibrated(rake(cells, targets), share).select(*DIMENSIONS, "weight", "probability")
    joined = thin.join(weighed, list(DIMENSIONS))
    return joined.select("doc_id", *DIMENSIONS, "n_tokens", "weight", "probability", drawn(F.col("doc_id"), F.col("probability"), seed).alias("selected"))


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, share: float = SHARE, seed: int = 17, topic: Column | None = None) -> DataFrame:
    """The drawn rows of `docs`, with all their columns."""
    _, cells = cells_of(docs, topic)
    if targets is None:
        targets = {dimension: tempered(cells, dimension) for dimension in DIMENSIONS}
    weighed = calibrated(rake(cells, targets), share)
    keys = [F.coalesce(F.col(d).cast("string"), F.lit(UNKNOWN)) for d in ("source", "lang")] + [topic_of(F.col("text")) if topic is None else topic]
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), *[k.alias(d) for k, d in zip(keys, DIMENSIONS)])
    return rows.join(weighed.select(*DIMENSIONS, "probability"), list(DIMENSIONS)).where(drawn(F.col("doc_id"), F.col("probability"), seed)).select("row.*")
