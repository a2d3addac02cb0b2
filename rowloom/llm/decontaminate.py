"""Finding and removing benchmark text in training documents.

The n-gram windows of the benchmark items go to every task as a set of hashes. Documents
are scanned window by window, and where a hash is in the set the words themselves are
compared. A benchmark of more than `block` windows is taken in blocks of that size, one
scan of the documents for each, so that what is sent to the tasks has a fixed bound.
No document row is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import configure
from .frames import cut, named_column, with_text
from .text import WordHashes, alnum_words, covered, window_hashes

WINDOW, BLOCK, FILTER_BITS = 10, 500_000, 20


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated, items (sorted item_ids as strings).

    Words are runs of letters, digits and non-ASCII characters, A-Z in lower case. A window
    is `window` consecutive words of an item (item_id, text); an item of fewer words, but
    not none, is one window. A document word inside any occurrence of a window is hit.

    Null text has no words. Items without words and an empty benchmark hit nothing. Items
    that are listed twice count once; an item without item_id hits words but is not listed.
    """
    scanned = _scanned(docs, ["doc_id"], benchmark, window, block)
    items = F.array_sort(F.array_distinct("items"))
    return scanned.select("row.doc_id", "n_words", "n_hit", items.alias("items")).select(
        "doc_id", F.col("n_words").cast("long"), F.col("n_hit").cast("long"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items",
    )


def remove_benchmark(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """`docs` with all its columns, without benchmark text.

    remove="documents" drops every document with a hit. remove="spans" cuts the hit words
    out, keeps the stretches between them as they were, one per line, and drops documents
    of which no word is left. Documents without hits stay as they are, empty ones too."""
    others = [c for c in docs.columns if c != "text"]
    left = _scanned(docs, others, benchmark, window, block)
    if remove == "documents":
        left, text = left.where("n_hit = 0"), F.col("bytes").cast("string")
    elif remove == "spans":
        left = left.where("n_hit = 0 or n_hit < n_words").withColumn("cleaned", F.expr("null").cast("binary"))
        left = left.mapInArrow(_without_hits, left.schema)
        text = F.when(F.col("n_hit") > 0, F.decode("cleaned", "utf-8")).otherwise(F.col("bytes").cast("string"))
    else:
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    return with_text(left, docs, text, F.col("n_hit") > 0)


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct (item, size, gram): the words of each window, joined by a blank."""

    def windows(batches):
        for batch in batches:
            items, sizes, grams = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = alnum_words(text)
                size = min(window, len(words))
                for at in range(len(words) - size + 1 if size else 0):
                    items.append(item)
                    sizes.append(size)
                    grams.append(b" ".join(words[at : at + size]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(sizes, pa.int32()), pa.array(grams, pa.binary())], ["item", "size", "gram"])

    source = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(windows, "item string, size int, gram binary").distinct()


def _scanned(docs: DataFrame, others: list[str], benchmark: DataFrame, window: int, block: int) -> DataFrame:
    """The columns `others` as `row`, the text as `bytes`, and what was found in it."""
    spark = configure(docs.sparkSession)
    windows = cut(_windows(benchmark, window), "benchmark-windows")
    blocks = max(1, -(-windows.count() // block))
    hits = docs.select(F.struct(*(named_column(c) for c in others)).alias("row"), F.col("text").cast("binary").alias("bytes"), F.expr("cast(null as binary)").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"), F.lit(0).alias("n_words"), F.lit(0).alias("n_hit"))
    for number in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("item", "gram"), F.lit(blocks)) == number)
        sent = spark.sparkContext.broadcast(_lookup(part.toArrow()))
        hits = hits.mapInArrow(lambda batches, sent=sent: _scan(batches, sent.value), hits.schema)
        if number % 4 == 3:
            hits = cut(hits, "scanned")
    return hits


def _lookup(table: pa.Table):
    """By size of window: a filter over leading hash bits, and the items of each window."""
    grams: dict[int, dict[bytes, list]] = {}
    for item, size, gram in zip(*(table[c].to_pylist() for c in ("item", "size", "gram"))):
        grams.setdefault(size, {}).setdefault(gram, []).append(item)
    hashes, sizes = WordHashes(), {}
    for size, known in grams.items():
        present = np.zeros(1 << FILTER_BITS, np.bool_)
        values = np.concatenate([window_hashes(hashes.of(gram.split(b" ")), size) for gram in known])
        present[values >> np.uint64(64 - FILTER_BITS)] = True
        sizes[size] = (present, np.sort(values), known)
    return sizes


def _scan(batches, lookup):
    hashes, shift = WordHashes(), np.uint64(64 - FILTER_BITS)
    for batch in batches:
        column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        texts, masks, before = column["bytes"], [], column["hits"].to_pylist()
        items, n_words, n_hit = column["items"].to_pylist(), [], []
        for k in range(batch.num_rows):
            words = alnum_words(texts[k].as_py())
            hashed = hashes.of(words)
            mask = np.zeros(len(words), np.bool_) if before[k] is None else np.unpackbits(np.frombuffer(before[k], np.uint8), count=len(words)).astype(np.bool_)
            for size, (present, values, known) in lookup.items():
                found = window_hashes(hashed, size)
                at = np.flatnonzero(present[found >> shift])
                if not len(at):
                    continue
                at = at[values[np.minimum(np.searchsorted(values, found[at]), len(values) - 1)] == found[at]]
                sure = [p for p in at.tolist() if b" ".join(words[p : p + size]) in known]
                if sure:
                    mask |= covered(np.array(sure), size, len(words))
                    for gram in {b" ".join(words[p : p + size]) for p in sure}:
                        items[k].extend(x for x in known[gram] if x is not None)
            items[k] = sorted(set(items[k]))
            n_words.append(len(words))
            n_hit.append(int(mask.sum()))
            masks.append(np.packbits(mask).tobytes() if n_hit[-1] else None)
        column |= {"hits": pa.array(masks, pa.binary()), "items": pa.array(items, pa.list_(pa.string())), "n_words": pa.array(n_words, pa.int32()), "n_hit": pa.array(n_hit, pa.int32())}
        yield pa.RecordBatch.from_arrays(list(column.values()), list(column))


def _without_hits(batches):
    """Fill `cleaned`: what is left between hit words, each stretch as it stood in the text."""
    import regex

    word = regex.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    for batch in batches:
        column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        cleaned = []
        for text, hits, count in zip(column["bytes"], column["hits"], column["n_words"].to_pylist()):
            if not hits.is_valid:
                cleaned.append(None)
                continue
            text, keep = text.as_py(), ~np.unpackbits(np.frombuffer(hits.as_py(), np.uint8), count=count).astype(np.bool_)
            spans = [m.span() for m in word.finditer(text)]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(np.int8), [0]])))
            cleaned.append(b"\n".join(text[spans[a][0] if a else 0 : spans[b][0] if b < count else len(text)].strip() if b == count else text[spans[a][0] if a else 0 : spans[b - 1][1]] for a, b in edges.reshape(-1, 2).tolist()))
        column["cleaned"] = pa.array(cleaned, pa.binary())
        yield pa.RecordBatch.from_arrays(list(column.values()), list(column))
