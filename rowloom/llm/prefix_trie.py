"""Conversations as a trie of their turns, by collapse of whole sequences.

A node is a distinct beginning of conversations; it is known by its depth and by the exclusive
or of 2 x 64-bit hashes of its turns and their places, so that it is a running total along the
conversation. Identical conversations are one sequence with a weight and a list of ends; only
one of them is spread out into its beginnings. Sequences that are a proper beginning of another
are told by an anti-join, the others are the leaves.

Sums over subtrees need no walk through the tree. A beginning that several conversations share
belongs to the one with the smallest id; of one conversation these are its last turns, as what
belongs to a smaller one does so with all that comes before. So each distinct turn below a node
is counted once, by the conversations that run through the node.

No conversation is taken as a whole: turns are put in order over ranges of rows, and totals run
over blocks of turns, with what came before each block added.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut, prepared

NODE = ("depth", "key", "key2")
ROOT = (0, 0, 0)
#: Turns of one conversation whose totals are made in one go.
BLOCK = 4096
#: Bytes of joined ids that are handed on as one row.
CHUNK = 1 << 20
#: Rules of the query: conversations come in families of so many ids, of which up to
#: `LONGEST_HEAD` turns of the first are put before the others.
FAMILY, LONGEST_HEAD = 20, 3


@dataclass
class Trie:
    """nodes: depth, key, key2 (which name a node), parent_key, parent_key2, conv_id,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens. ends: depth, key, key2 of the
    node at which each conversation ends, and its conv_id."""

    nodes: DataFrame
    ends: DataFrame


def placed(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), turn_hash, turn_hash2, words of every turn that has a conv_id.

    Turns are in the order of `turn`, null first, and of equal ones in that of role and text.
    A null role or text counts as empty."""
    prepared(conversations.sparkSession)
    role, text = (F.coalesce(name, F.lit("")) for name in ("role", "text"))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    # Rows that are alike in all columns differ in `row`, so that ranges can part them.
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part"),
        F.xxhash64("role", "text").alias("turn_hash"), F.xxhash64(F.lit(1), "role", "text").alias("turn_hash2"), words.alias("words"),
    )
    ordered = cut(ordered, "turns")
    here = Window.partitionBy("conv_id", "part")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # At most one conversation goes on from one range to the next: one row for each range.
    sizes = ordered.groupBy("conv_id", "part").count().withColumn("before", F.sum("count").over(earlier)).where("before is not null")
    numbered = ordered.withColumn("place", F.row_number().over(here.orderBy("at"))).join(F.broadcast(sizes.select("conv_id", "part", "before")), ["conv_id", "part"], "left")
    return numbered.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "turn_hash", "turn_hash2", "words")


def with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query's rebuilt conversations: (conv_id, depth, turn_hash, turn_hash2, words) of their
    turns, and (conv_id, length) of all of them, also those left without turns."""
    turns = cut(turns, "placed")
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (LONGEST_HEAD + 1)).alias("head")
    sizes = turns.groupBy("conv_id").agg(F.max("place").alias("size"))
    firsts = sizes.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("first"), F.col("size").alias("first_size"))
    convs = sizes.select("conv_id", "size", head, (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first")).join(firsts, "first", "left")
    convs = convs.withColumn("lent", F.least("head", F.coalesce("first_size", F.lit(0))))
    convs = cut(convs.select("conv_id", "first", "head", "lent", (F.col("lent") + F.greatest(F.col("size") - F.col("head"), F.lit(0))).alias("length")), "convs")
    heads = turns.where((F.col("place") <= LONGEST_HEAD) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "first")
    lent = convs.join(heads, "first").where("place <= lent").withColumnRenamed("place", "depth")
    own = turns.join(convs, "conv_id").where("place > head").withColumn("depth", F.col("place") - F.col("head") + F.col("lent"))
    columns = ["conv_id", F.col("depth").cast("long"), "turn_hash", "turn_hash2", "words"]
    return lent.select(*columns).unionByName(own.select(*columns)), convs.select("conv_id", F.col("length").cast("long"))


def _with_totals(turns: DataFrame) -> DataFrame:
    """With the key of the beginning that each turn ends, of the one before it, and the words
    before the turn."""
    term, term2 = F.xxhash64("depth", "turn_hash", "turn_hash2"), F.xxhash64("depth", "turn_hash2", "turn_hash")
    rows = turns.select("conv_id", "depth", "words", term.alias("term"), term2.alias("term2"), F.floor((F.col("depth") - 1) / BLOCK).alias("block"))
    running = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({"key": F.bit_xor("term").over(running), "key2": F.bit_xor("term2").over(running), "upto": F.sum("words").over(running)})
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("term").alias("b1"), F.bit_xor("term2").alias("b2"), F.sum("words").alias("bw"))
    past = blocks.select("conv_id", "block", F.bit_xor("b1").over(earlier).alias("past"), F.bit_xor("b2").over(earlier).alias("past2"), F.sum("bw").over(earlier).alias("past_words")).where("block > 0")
    whole = local.join(past, ["conv_id", "block"], "left")
    key, key2 = (F.col(k).bitwiseXOR(F.coalesce(p, F.lit(0))) for k, p in (("key", "past"), ("key2", "past2")))
    return whole.select(
        "conv_id", "depth", "words", key.alias("key"), key2.alias("key2"),
        key.bitwiseXOR(F.col("term")).alias("parent_key"), key2.bitwiseXOR(F.col("term2")).alias("parent_key2"),
        (F.col("upto") - F.col("words") + F.coalesce("past_words", F.lit(0))).alias("before"),
    )


def prefix_trie(turns: DataFrame, convs: DataFrame) -> Trie:
    """The trie of the conversations `convs` (conv_id, length), whose turns `turns` gives by
    conv_id and depth (from 1, without gaps) as hashes and a number of words.

    A node's n_convs are the conversations that begin with it, conv_id the smallest of them,
    n_leaves the childless nodes in its subtree and saved_tokens the sum, over its subtree, of
    (n_convs - 1) times the words of the last turn. Without conversations there is no node, not
    even a root. Extra columns are not read. Turn hashes (2 x 64 bits) stand for role and text.
    """
    turns = cut(_with_totals(turns), "beginnings")
    last = convs.where("length > 0").withColumnRenamed("length", "depth").join(turns, ["conv_id", "depth"])
    closed = last.select("conv_id", *NODE, (F.col("before") + F.col("words")).alias("total"))
    silent = convs.where("length = 0").select("conv_id", *(F.lit(v).cast("long").alias(n) for n, v in zip(NODE, ROOT)), F.lit(0).cast("long").alias("total"))
    ends = cut(closed.unionByName(silent), "ends")

    # One conversation stands for all that are identical.
    sequences = cut(ends.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.max("total").alias("total")), "sequences")
    standing = sequences.select("conv_id", "weight", "total", F.col("depth").alias("length"))
    roots = standing.select("conv_id", F.lit(0).cast("long").alias("words"), *(F.lit(v).cast("long").alias(n) for n, v in zip((*NODE, "parent_key", "parent_key2", "before"), (*ROOT, 0, 0, 0))), "weight", "total", "length")
    paths = cut(turns.join(standing, "conv_id").select(roots.columns).unionByName(roots), "paths")

    inner = paths.where("depth < length").select(*NODE).distinct()
    leaves = sequences.join(inner, list(NODE), "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    # What belongs to a conversation begins at its topmost own node.
    owners = paths.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.min("before").alias("before"))
    tops = owners.groupBy("conv_id").agg(F.min("depth").alias("top"), F.min("before").alias("top_before"))
    along = paths.join(standing.select("conv_id").join(leaves, "conv_id", "left").join(tops, "conv_id", "left"), "conv_id")
    rest = F.col("total") - F.col("before")
    own: Column = F.when(F.col("depth") >= F.col("top"), rest).otherwise(F.coalesce(F.col("total") - F.col("top_before"), F.lit(0)))
    nodes = along.groupBy(*NODE).agg(
        F.min("parent_key").alias("parent_key"), F.min("parent_key2").alias("parent_key2"), F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"),
        F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum(F.col("weight") * rest - own).alias("saved_tokens"),
    )
    nodes = cut(nodes, "nodes")

    above = [(F.col("depth") - 1).alias("depth"), F.col("parent_key").alias("key"), F.col("parent_key2").alias("key2")]
    children = nodes.where("depth > 0").groupBy(*above).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent_key"), F.col("key2").alias("parent_key2"), F.col("conv_id").alias("parent_conv_id"))
    # All nodes of depth 1 have one parent: its single row goes to them instead.
    deep = nodes.where("depth > 1").join(parents.where("depth > 1"), ["depth", "parent_key", "parent_key2"], "left")
    shallow = nodes.where("depth <= 1").join(F.broadcast(parents.where("depth = 1")), ["depth", "parent_key", "parent_key2"], "left")
    linked = deep.unionByName(shallow).join(children, list(NODE), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    return Trie(linked, ends.select(*NODE, "conv_id"))


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, key, key2 and ends_sha256: SHA-256 of the ids that end at the node, ascending and
    with commas between. The ids of a node come in order, joined to chunks where they lie, and
    only one chunk at a time is held; a digest itself can only be made in one go."""
    order = [*NODE, "conv_id"]
    schema = "depth long, key long, key2 long"

    def joined(batches):
        node, first, held, size = None, None, [], 0

        def out():
            values = [[v] for v in (*node, first)] + [[",".join(held)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.int64()] * 4 + [pa.string()])], [*NODE, "first", "ids"])

        for batch in batches:
            for *now, conv_id in zip(*(column.to_pylist() for column in batch.columns)):
                text = str(conv_id)
                if now != node or size > CHUNK:
                    if held:
                        yield out()
                    node, first, held, size = now, conv_id, [], 0
                held.append(text)
                size += len(text) + 1
        if held:
            yield out()

    def hashed(batches):
        node, digest, done = None, None, []

        def out():
            columns = list(zip(*done))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, [pa.int64()] * 3 + [pa.string()])], [*NODE, "ends_sha256"])

        for batch in batches:
            for *now, ids in zip(*(batch.column(n).to_pylist() for n in (*NODE, "ids"))):
                if now == node:
                    digest.update(b",")
                else:
                    if digest:
                        done.append((*node, digest.hexdigest()))
                    node, digest = now, hashlib.sha256()
                    if len(done) > 10_000:
                        yield out()
                        done.clear()
                digest.update(ids.encode())
        if digest:
            done.append((*node, digest.hexdigest()))
        if done:
            yield out()

    chunks = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, f"{schema}, first long, ids string")
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, f"{schema}, ends_sha256 string")
