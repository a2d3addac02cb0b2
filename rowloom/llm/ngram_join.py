"""Similarity join of documents on the Jaccard similarity of their word n-grams.

Documents with equal n-gram sets form a class, and classes are joined. The n-grams of a
class are ordered rare first; two sets that are similar enough share an n-gram among
their first few (their prefixes). Classes meet on such an n-gram, pairs pass a length, a
positional and a suffix filter, and each pair that is left is verified once.

N-grams are 64-bit hashes. The order only has to be the same everywhere. An n-gram is at
most as frequent as its rarest word, so n-grams are ordered by that word's count, to the
power of two, from a table of counters of fixed size, filled from all documents, in which
words with the same leading hash bits share a counter.

Where an n-gram is in more than `hot` prefixes, its pairs are not made as rows: classes
connected by such n-grams are a family, cut into blocks by length and hash, and each task
compares two blocks and returns at most a spanning forest of the links and a count per class.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import components, cut, texts
from .text import WordHashes, lower_words, shingle_set, window_hashes

COUNTER_BITS, LEVELS, HOT, BLOCK_CLASSES, BLOCK_SHINGLES, RANGES = 22, 16, 128, 512, 2_000_000, 16


def needed(size: int, percent: int) -> int:
    """Smallest size of a set similar enough to one of `size`; also their least overlap."""
    return -(-percent * size // 100)


def join_ngrams(docs: DataFrame, n: int = 3, percent: int = 90, hot: int = HOT) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, n_links.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of
    lower-cased word n-grams. component_id is the smallest doc_id reachable by links, the
    document's own if it has none; n_links counts the other rows linked directly.

    Text that is null or without words has an empty set and links with nothing. A text of
    fewer than n words has one n-gram, all its words. Repeated rows are copies. A row without doc_id gets no component. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    source = texts(docs)
    counters = spark.sparkContext.broadcast(counted(source))
    rows = cut(source.mapInArrow(lambda batches: prefixes(batches, counters.value, n, percent), "doc_id long, size int, f1 long, f2 long, head array<long>, ranges array<int>"), "prefixes")

    # A class is named by the hash of its set, and stands for its smallest doc_id.
    classes = rows.where("size > 0 and doc_id is not null").groupBy(F.col("f1").alias("rep"), "f2").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("head").alias("head"), F.first("ranges").alias("ranges")
    )
    classes = cut(classes, "classes")
    postings = classes.select("rep", "size", F.posexplode("head").alias("at", "token"))
    met = postings.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    postings = cut(postings.join(met, "token"), "postings")

    family = families(postings.where(F.col("n") > hot))
    facts = classes.select("rep", "ranges").join(family, "rep", "left")
    pairs = cut(paired(postings.where(F.col("n") <= hot), facts, percent), "pairs")
    blocks = cut(blocked(family.join(classes.select("rep", "size", "copies"), "rep"), percent), "blocks")

    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(blocks.select("rep")).distinct()
    ids = classes.join(wanted, "rep", "left_semi").select(F.col("least").alias("doc_id"))
    sets = cut(source.join(ids, "doc_id", "left_semi").mapInArrow(lambda batches: sets_of(batches, n), "rep long, grams binary").dropDuplicates(["rep"]), "sets")

    sizes = classes.select("rep", "copies")
    left, right = sets.toDF("a", "grams_a"), sets.toDF("b", "grams_b")
    links = pairs.join(left, "a").join(right, "b").mapInArrow(lambda batches: verified(batches, percent), "a long, b long")
    links = links.join(sizes.toDF("a", "copies_a"), "a").join(sizes.toDF("b", "copies_b"), "b")
    ends = F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("copies_b").alias("links")), F.struct(F.col("b").alias("rep"), F.col("copies_a").alias("links"))))
    compared = blocks.join(sets, "rep").groupBy("family", "low", "high", "i", "j").applyInArrow(lambda table: within(table, percent), "a long, b long, links long")
    found = cut(links.select("a", "b", ends.alias("of")).select("a", "b", "of.rep", "of.links").union(compared.select("a", "b", F.when(F.col("b").isNull(), F.col("a")), "links")), "links")

    component = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    linked = component.join(classes.select("rep", "least"), "rep")
    component = linked.join(linked.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("rep", "component_id")
    degree = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_class = classes.select("rep", "f2", "least", "copies").join(component, "rep", "left").join(degree, "rep", "left").select(
        F.col("rep").alias("f1"), "f2", F.coalesce("component_id", "least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    thin = rows.select("doc_id", F.col("size").cast("long").alias("n_shingles"), "f1", "f2")
    joined = thin.where("n_shingles > 0 and doc_id is not null").join(of_class, ["f1", "f2"]).select("doc_id", "n_shingles", "component_id", "n_links")
    alone = thin.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return joined.union(alone)


def counted(source: DataFrame) -> np.ndarray:
    """How often the words of each counter occur, as the whole logarithm to base 2: 2**22
    small numbers at every size of input, brought in as one bit map for each of 16 levels."""

    def tally(batches):
        counts, hashes, shift = np.zeros(1 << COUNTER_BITS, np.uint32), WordHashes(), np.uint64(64 - COUNTER_BITS)
        for batch in batches:
            for text in batch.column(1):
                np.add.at(counts, (hashes.of(lower_words(text.as_py())) >> shift).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        for first in range(0, len(at), 100_000):
            part = at[first : first + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part].astype(np.int64))], ["counter", "n"])

    counts = source.mapInArrow(tally, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    levels = counts.select((F.col("counter").cast("long") + 1).alias("place"), F.least(F.lit(LEVELS - 1), F.floor(F.log2("n"))).alias("level"))
    return maps_of(levels)


def maps_of(levels: DataFrame) -> np.ndarray:
    """Levels by counter, from rows (place from 1 on, level)."""
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    maps = levels.groupBy("level", F.bitmap_bucket_number("place").alias("bucket")).agg(bits)
    found, span = np.zeros(1 << COUNTER_BITS, np.uint8), 8 * 4096
    for level, bucket, part in maps.collect():
        at = np.flatnonzero(np.unpackbits(np.frombuffer(part, np.uint8), bitorder="little"))
        found[at + (bucket - 1) * span] = level
    return found


def rare_first(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of a text's words, and their order: by the counter of their
    rarest word, then by hash."""
    n = min(n, len(hashes))
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    of_words = counts[(hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
    rarest = np.lib.stride_tricks.sliding_window_view(of_words, n).min(1)
    grams, at = np.unique(window_hashes(hashes, n), return_index=True)
    return grams, np.lexsort((grams, rarest[at]))


def prefixes(batches, counts: np.ndarray, n: int, percent: int):
    hashes = WordHashes()
    for batch in batches:
        sizes, first, second, heads, ranges = [], [], [], [], []
        for text in batch.column(1):
            grams, order = rare_first(hashes.of(lower_words(text.as_py())), counts, n)
            f1, f2 = class_of(grams.tobytes())
            heads.append(grams[order[: len(grams) - needed(len(grams), percent) + 1]].view(np.int64))
            sizes.append(len(grams))
            first.append(f1)
            second.append(f2)
            ranges.append(np.bincount((grams >> np.uint64(60)).astype(np.int64), minlength=RANGES).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int32()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(heads, pa.list_(pa.int64())), pa.array(ranges, pa.list_(pa.int32()))],
            ["doc_id", "size", "f1", "f2", "head", "ranges"],
        )


def families(hot: DataFrame) -> DataFrame:
    """(rep, family) of the classes with hot n-grams: those that hot n-grams connect."""
    first = hot.groupBy("rep").agg(F.min("token").alias("first"))
    token_edges = hot.join(first, "rep").select(F.col("token").alias("a"), F.col("first").alias("b")).distinct()
    parts = components(token_edges)
    return cut(first.join(parts.select(F.col("node").alias("first"), F.col("component").alias("family")), "first", "left").select("rep", F.coalesce("family", "first").alias("family")), "families")


def paired(cold: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that meet on an n-gram and pass the filters.

    With the overlap that the sizes call for, a pair goes if the sizes differ too much, if
    what follows the meeting point is too short, or if sixteen ranges of hash values show
    more differing n-grams than there may be. Pairs of one family are left to its blocks."""
    a, b = (cold.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("rep", "size", "at")]) for side in "ab")
    both = F.col("size_a") + F.col("size_b")
    overlap = F.ceil(F.lit(percent) * both / (100 + percent))
    met = a.join(b, (a["token"] == b["token"]) & (F.col("rep_a") < F.col("rep_b"))).where(
        (F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent)
        & (F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) >= overlap)
    )
    pairs = met.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), "size_a", "size_b").distinct()
    for side in "ab":
        pairs = pairs.join(facts.select(F.col("rep").alias(side), F.col("ranges").alias(f"ranges_{side}"), F.col("family").alias(f"family_{side}")), side)
    apart = F.aggregate(F.zip_with("ranges_a", "ranges_b", lambda x, y: F.abs(x - y)), F.lit(0), lambda total, x: total + x)
    return pairs.where((apart <= both - 2 * overlap) & ~F.coalesce(F.col("family_a") == F.col("family_b"), F.lit(False))).select("a", "b")


def blocked(members: DataFrame, percent: int) -> DataFrame:
    """Each class of a family, once for each pair of blocks in which it is compared.

    Lengths are cut into bands so wide that similar sets lie in the same or in neighbouring
    bands; a band is cut into blocks of bounded size. Similar sizes differ by a factor of
    at most 100 / percent. From 85 % on bands are no narrower than for 85 %."""
    width = math.log(100 / min(percent, 85)) + 1e-6
    members = members.withColumn("band", F.floor(F.log(F.col("size")) / width))
    cuts = members.groupBy("family", "band").agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("blocks"))
    above = cuts.select("family", (F.col("band") - 1).alias("band"), F.col("blocks").alias("blocks_above"))
    below = cuts.select("family", (F.col("band") + 1).alias("band"), F.col("blocks").alias("blocks_below"))
    around = cuts.join(above, ["family", "band"], "left").join(below, ["family", "band"], "left")
    placed = members.join(around, ["family", "band"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    here, up, down = F.col("band"), F.col("band") + 1, F.col("band") - 1

    def places(count: str, make):
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(count) - 1), make)).otherwise(F.array().cast("array<struct<low:bigint,high:bigint,i:bigint,j:bigint>>"))

    def place(low, high, i, j):
        return F.struct(low.alias("low"), high.alias("high"), i.alias("i"), j.alias("j"))

    own = F.col("block")
    keys = F.concat(
        places("blocks", lambda x: place(here, here, F.least(own, x), F.greatest(own, x))),
        places("blocks_above", lambda x: place(here, up, own, x)),
        places("blocks_below", lambda x: place(down, here, x, own)),
    )
    return placed.select("rep", "copies", "family", "band", "block", F.explode(keys).alias("key")).select("rep", "copies", "family", "band", "block", "key.*")


def sets_of(batches, n: int):
    hashes = WordHashes()
    for batch in batches:
        grams = [shingle_set(hashes.of(lower_words(text.as_py())), n).tobytes() for text in batch.column(1)]
        names = [class_of(x)[0] for x in grams]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(grams, pa.binary())], ["rep", "grams"])


def class_of(grams: bytes) -> np.ndarray:
    return np.frombuffer(xxhash.xxh3_128_digest(grams), np.int64)


def verified(batches, percent: int):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("grams_a"), batch.column("grams_b")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two bounded lists of sets."""
    grams = np.concatenate(left + right)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    values, column, count = np.unique(grams, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    renumber = np.cumsum(count > 1) - 1
    column, owner = renumber[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total, width = np.zeros((len(left), len(right)), np.float32), 2048
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, [first, first + width])
        part = np.zeros((len(left) + len(right), width), np.float32)
        part[owner[low:high], column[low:high] - first] = 1
        total += part[: len(left)] @ part[len(left) :].T
    return total


def within(table: pa.Table, percent: int) -> pa.Table:
    """Links between two blocks (or inside one): a spanning forest, and per class the
    number of documents it links with."""
    rep, copies = table["rep"].to_numpy(), table["copies"].to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["grams"]]
    low, high, i, j = (table[c][0].as_py() for c in ("low", "high", "i", "j"))
    band, block = table["band"].to_numpy(), table["block"].to_numpy()
    same = low == high and i == j
    one = np.flatnonzero((band == low) & (block == i))
    other = one if same else np.flatnonzero((band == high) & (block == j))
    edges_a, edges_b, nodes, links = [], [], [], []
    if len(one) and len(other):
        size = np.array([len(x) for x in sets])
        shared = overlaps([sets[k] for k in one], [sets[k] for k in other])
        linked = 100 * shared >= percent * (size[one][:, None] + size[other][None, :] - shared)
        if same:
            np.fill_diagonal(linked, False)
        sums = [(one, linked @ copies[other])] + ([] if same else [(other, linked.T @ copies[one])])
        for who, total in sums:
            nodes += rep[who[total > 0]].tolist()
            links += total[total > 0].tolist()
        parent = list(range(len(rep)))

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for row, mine in enumerate(one.tolist()):
            for theirs in other[linked[row]].tolist():
                p, q = root(mine), root(theirs)
                if p != q:
                    parent[p] = q
                    edges_a.append(rep[mine])
                    edges_b.append(rep[theirs])
    empty = [None] * len(nodes)
    return pa.table({
        "a": pa.array(edges_a + nodes, pa.int64()), "b": pa.array(edges_b + empty, pa.int64()), "links": pa.array([0] * len(edges_a) + links, pa.int64()),
    })
