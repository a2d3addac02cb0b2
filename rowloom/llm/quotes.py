"""Linking quotations to the messages they quote.

A line's quote level is the number of '>' it begins with. Lines of level 0 are a message's
own text; runs of lines of one level are passages. Every line and every whole text is
hashed in normal form, and the earliest message that says it first-hand is its origin: in the
same conversation if there is one, else in any. A message answers the origin of most words
it quotes at the first level. Following these links to their start gives threads, in which
every reply comes after what it answers, without the quoted text.

Origins are aggregated to one row per hash before any join, so a line that everyone writes
costs no more than a rare one, and no conversation is gathered in one place.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import configure
from .frames import cut

LEVEL = re.compile(r"^[ \t]*((?:>[ \t]?)+)")


def _units(lines: list[str]) -> dict[int, int]:
    """Hash -> number of words, of each line and of all lines together, in normal form:
    lower case, one blank between words."""
    words = [" ".join(line.lower().split()) for line in lines]
    units = {}
    for text in [*words, "\n".join(w for w in words if w)]:
        if text:
            units[xxhash.xxh3_64_intdigest(text) - (1 << 63)] = len(text.split())
    return units


def parse(text: str | None) -> tuple[str, list[tuple[int, list[str]]]]:
    """Own text, and the quoted passages as (level, lines)."""
    own, passages = [], []
    for line in (text or "").split("\n"):
        mark = LEVEL.match(line)
        if not mark:
            own.append(line)
            passages.append((0, []))
            continue
        level, rest = mark[1].count(">"), line[mark.end() :]
        if passages and passages[-1][0] == level:
            passages[-1][1].append(rest)
        else:
            passages.append((level, [rest]))
    return "\n".join(own).strip("\n"), [p for p in passages if p[0]]


def _parsed(messages: DataFrame) -> DataFrame:
    unit = pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("words", pa.int32())])

    def run(batches):
        for batch in batches:
            owns, levels, units = [], [], []
            for text in batch.column("text").to_pylist():
                own, passages = parse(text)
                owns.append(own if text is not None else None)
                levels.append(max((level for level, _ in passages), default=0))
                found = [(0, h, n) for h, n in _units(own.split("\n")).items()]
                quoted: dict[tuple[int, int], int] = {}
                for level, lines in passages:
                    quoted |= {(level, h): n for h, n in _units(lines).items()}
                found += [(level, h, n) for (level, h), n in quoted.items()]
                units.append([{"level": level, "hash": h, "words": n} for level, h, n in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array(owns, pa.string()), pa.array(levels, pa.int32()), pa.array(units, pa.list_(unit))],
                ["conv_id", "turn", "role", "own", "quote_levels", "units"],
            )

    return messages.mapInArrow(run, "conv_id long, turn long, role string, own string, quote_levels int, units array<struct<level:int,hash:long,words:int>>")


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row per message of `messages` (conv_id, turn, role, text): conv_id, turn, role,
    text (its own, without quotes), quote_levels, n_linked, n_unlinked (quoted units with
    and without an origin), reply_conv, reply_turn (null: it starts a thread), thread_conv,
    thread_turn, depth; ordered by thread, then conversation and turn.

    An origin is always earlier than what quotes it: by conv_id, then turn. Of two messages
    that say the same the earlier is the origin; of two origins with as many quoted words
    the earlier is answered. Null text has neither own text nor quotes; an empty text is one
    empty message. Rows with the same conv_id and turn are one message, the first by role
    and text; rows without either are dropped, as nothing can point to them."""
    spark = configure(messages.sparkSession)
    rows = messages.where("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = rows.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select("conv_id", "turn", "m.role", "m.text")
    parsed = cut(_parsed(rows), "messages")
    units = parsed.select("conv_id", "turn", F.explode("units").alias("u")).select("conv_id", "turn", "u.*")
    said = units.where("level = 0")
    here = said.groupBy("conv_id", "hash").agg(F.min("turn").alias("here"))
    anywhere = here.groupBy("hash").agg(F.min(F.struct(F.col("conv_id").alias("conv"), F.col("here").alias("turn"))).alias("far"))
    quoted = units.where("level > 0").join(here, ["conv_id", "hash"], "left").join(anywhere, "hash", "left")
    own = F.when(F.col("here") < F.col("turn"), F.struct(F.col("conv_id").alias("conv"), F.col("here").alias("turn")))
    far = F.when((F.col("far.conv") < F.col("conv_id")) | ((F.col("far.conv") == F.col("conv_id")) & (F.col("far.turn") < F.col("turn"))), F.col("far"))
    linked = quoted.select("conv_id", "turn", "level", "words", F.coalesce(own, far).alias("origin"))
    weight = linked.groupBy("conv_id", "turn", "origin").agg(F.sum(F.when(F.col("level") == 1, F.col("words")).otherwise(F.lit(0))).alias("words"), F.count("*").alias("n"))
    best = F.min(F.when(F.col("origin").isNotNull() & (F.col("words") > 0), F.struct((-F.col("words")).alias("less"), F.col("origin").alias("origin"))))
    replies = weight.groupBy("conv_id", "turn").agg(
        best.alias("best"), F.sum(F.when(F.col("origin").isNotNull(), F.col("n")).otherwise(F.lit(0))).alias("n_linked"), F.sum(F.when(F.col("origin").isNull(), F.col("n")).otherwise(F.lit(0))).alias("n_unlinked")
    )
    linked_rows = cut(
        parsed.drop("units").join(replies, ["conv_id", "turn"], "left").select(
            "conv_id", "turn", "role", F.col("own").alias("text"), "quote_levels", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.coalesce("n_unlinked", F.lit(0)).cast("long").alias("n_unlinked"),
            F.col("best.origin.conv").alias("reply_conv"), F.col("best.origin.turn").alias("reply_turn"),
        ),
        "linked",
    )
    threads = _threads(linked_rows)
    out = linked_rows.join(threads, ["conv_id", "turn"])
    return out.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "thread_conv", "thread_turn", "conv_id", "turn").sortWithinPartitions("thread_conv", "thread_turn", "conv_id", "turn")


def _threads(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_conv, thread_turn, depth): pointers to what a message answers
    are doubled until all reach the start of their thread."""
    state = rows.select("conv_id", "turn", F.coalesce("reply_conv", "conv_id").alias("thread_conv"), F.coalesce("reply_turn", "turn").alias("thread_turn"), F.col("reply_conv").isNotNull().cast("long").alias("depth"))
    state = cut(state, "threads")
    while True:
        # A start points to itself; where none points to anything but a start, all is done.
        onward = state.where("depth > 0").select(F.col("conv_id").alias("thread_conv"), F.col("turn").alias("thread_turn"), F.col("thread_conv").alias("to_conv"), F.col("thread_turn").alias("to_turn"), F.col("depth").alias("more"))
        state_next = state.join(onward, ["thread_conv", "thread_turn"], "left").select(
            "conv_id", "turn", F.coalesce("to_conv", "thread_conv").alias("thread_conv"), F.coalesce("to_turn", "thread_turn").alias("thread_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("more").isNotNull().alias("moved")
        )
        state_next = cut(state_next, "threads")
        moved = not state_next.where("moved").isEmpty()
        state = state_next.drop("moved")
        if not moved:
            return state


def with_quotes(messages: DataFrame) -> DataFrame:
    """`messages` (conv_id, turn, role, text) as a mail program would send them: two of three
    that have a predecessor quote it, one of these with what that had quoted."""
    def quoted(column):
        return F.concat(F.lit("> "), F.regexp_replace(column, "\n", "\n> "), F.lit("\n"))

    kind = F.crc32(F.concat_ws(":", "conv_id", "turn").cast("binary")) % 3
    one = messages.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("one"))
    two = messages.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("text").alias("two"))
    joined = messages.join(one, ["conv_id", "turn"], "left").join(two, ["conv_id", "turn"], "left")
    deep = F.when((kind == 2) & F.col("two").isNotNull(), quoted(quoted(F.col("two")))).otherwise(F.lit(""))
    deep = F.regexp_replace(deep, "> \n$", "")
    body = F.when((kind > 0) & F.col("one").isNotNull(), F.concat(deep, quoted(F.col("one")), F.col("text"))).otherwise(F.col("text"))
    return joined.select("conv_id", "turn", "role", body.alias("text"))
