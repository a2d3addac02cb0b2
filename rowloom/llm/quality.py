"""Quality rules as a ledger of bits.

Every rule is evaluated once per document. The ledger holds the measurements and one long
whose bit k says that rule k failed. A policy is a version and a mask: a document is kept
if none of the masked bits is set. Changing a policy, or asking what a rule costs, reads
the ledger and never the text again. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import configure

BLANKS = " \t\n\u000b\f\r"
GAP = r"[ \x09-\x0D]+"
WINDOW = 5

#: Name and failing condition over the measurements; the place in the list is the bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("shouting", "2 * n_upper > word_chars"),
    ("long_words", "word_chars > 20 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
]
BASE = 0b11
#: Policies by version: the bits that reject a document.
POLICIES: dict[str, int] = {"v1": BASE, "v2": 0b1111, "v3": 0b1111111}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once per row, also where it is used in lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words between ASCII white space; none in null or blank text."""
    return let(F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, GAP)))


def _positions(count: Column) -> Column:
    return F.sequence(F.lit(0), count - WINDOW)


def repeated_words(words: Column) -> Column:
    """Words inside windows found twice or more in the text.

    Hashes of windows tell the texts that may have any. In those the windows themselves are
    sorted with their places, and the places of equal neighbours are put in order again."""

    def spelled(words):
        grams = F.transform(_positions(F.size(words)), lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("gram"), i.alias("at")))

        def places(ordered):
            def twin(x, k):
                return F.coalesce(F.get(ordered, k - 1)["gram"] == x["gram"], F.lit(False)) | F.coalesce(F.get(ordered, k + 1)["gram"] == x["gram"], F.lit(False))

            return F.sort_array(F.transform(F.filter(ordered, twin), lambda x: x["at"]))

        def add(seen, at):
            return F.struct((seen["total"] + F.least(F.lit(WINDOW), at - seen["last"])).alias("total"), at.alias("last"))

        start = F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(let(F.sort_array(grams), places), start, add, lambda seen: seen["total"])

    def hashed(hashes):
        windows = F.transform(_positions(F.size(hashes)), lambda i: F.xxhash64(*[hashes[i + k] for k in range(WINDOW)]))
        return let(windows, lambda w: F.size(F.array_distinct(w)) < F.size(w))

    some = let(F.transform(words, lambda w: F.xxhash64(w)), hashed)
    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).when(some, spelled(words)).otherwise(F.lit(0))


def ledger(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, the measurements n_words,
    word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper (long), and
    failed_bits.

    Null text measures 0 everywhere, and so fails `few_words` alone."""
    configure(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \x09-\x0D]"))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    of_words = let(words_of(text), lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    measured = docs.select(
        "doc_id", of_words.alias("w"), of_lines.alias("l"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).alias("n_symbols"), F.length(F.regexp_replace(text, r"\P{Lu}+", "")).alias("n_upper"),
    )
    measures = {"n_words": "w.n_words", "word_chars": "w.word_chars", "n_symbols": "n_symbols", "n_lines": "l.n_lines", "n_dup_lines": "l.n_dup_lines", "n_repeat_words": "w.n_repeat_words", "n_upper": "n_upper"}
    flat = measured.select("doc_id", *[F.col(source).cast("long").alias(name) for name, source in measures.items()])
    bits = None
    for bit, (_, failing) in enumerate(RULES):
        one = F.when(F.expr(failing), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long")
        bits = one if bits is None else bits.bitwiseOR(one)
    return flat.withColumn("failed_bits", bits)


def apply_policy(rows: DataFrame, version: str = "v3", policies: dict[str, int] | None = None) -> DataFrame:
    """`rows` of a ledger with kept (no masked bit is set) under one policy."""
    mask = (policies or POLICIES)[version]
    return rows.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")) == 0)


def ablations(rows: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """version, rule, n_failed, n_alone (rejected by this rule only), n_kept, n_kept_without.

    Rows are counted by distinct bits first, at most one per combination of rules."""
    counts = rows.groupBy("failed_bits").agg(F.count("*").alias("n"))
    of = [(version, mask, rule, 1 << bit) for version, mask in (policies or POLICIES).items() for bit, (rule, _) in enumerate(RULES) if mask >> bit & 1]
    cases = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.lit(m).cast("long").alias("mask"), F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit")) for v, m, r, b in of]))
    each = counts.select("failed_bits", "n", cases.alias("case")).select("failed_bits", "n", "case.*")
    masked = F.col("failed_bits").bitwiseAND(F.col("mask"))
    without = masked.bitwiseAND(F.bitwise_not(F.col("bit")))

    def number(condition):
        return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)).cast("long"))

    return each.groupBy("version", "rule").agg(
        number(F.col("failed_bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), number(masked == F.col("bit")).alias("n_alone"),
        number(masked == 0).alias("n_kept"), number(without == 0).alias("n_kept_without"),
    )
