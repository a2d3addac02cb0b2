"""Removing long word sequences that occur more than once.

A window is `size` consecutive words. Counting every window of a corpus exactly would
shuffle it whole, so windows that occur once are recognised first:

* Every window has a minimiser, the least hash among the 16-word runs inside it. Equal
  windows have the same minimiser at the same offset, so a window occurs at most as often
  as its minimiser does, and there is about one minimiser for every ten windows.
* Each partition counts its minimisers in a count-min sketch of two rows of 2**26 counters;
  the sketches are added up. A counter never falls below the true count, so a window whose
  estimate is one occurs once. The sketch has one size for every input. When a larger
  input fills it, more windows pass on to the exact stage, and none is lost.
* Windows estimated repeated are grouped exactly by a 64-bit hash. Windows met twice by the
  same task are settled there, and one row tells the other tasks.

What was found returns to the documents as runs of window starts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import named_column, prepared, with_text
from .text import MIX_1, WordHashes, blank_words, mixed, window_hashes

SIZE, RUN, SKETCH_BITS, HELD = 35, 16, 26, 1_500_000
WORD = regex.compile(rb"[^\x20\x09-\x0D]+")


def find_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, n_removed, kept_sha256.

    A word goes if it is covered by a window of `size` words whose word sequence also
    starts anywhere else, in the same document too. Windows are judged on the input.
    kept_sha256 is over the kept words joined by one blank.

    Null text, and text without words, has no words and the hash of nothing. A text of
    fewer than `size` words has no window. A repeated row repeats its windows. Empty
    tables give empty tables.
    """
    return _settled(docs, ["doc_id"], size).select("row.doc_id", F.col("n_words").cast("long"), F.col("n_removed").cast("long"), "kept_sha256")


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """`docs` with all its columns, without repeated windows.

    A text that loses words keeps the stretches between as they stood, one per line; where
    there is a column n_chars it follows. A document that loses every word is dropped.
    Others stay as they are, empty ones too."""
    left = _settled(docs, [c for c in docs.columns if c != "text"], size).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.decode("kept", "utf-8")).otherwise(F.col("bytes").cast("string"))
    return with_text(left, docs, text, F.col("n_removed") > 0)


def _settled(docs: DataFrame, others: list[str], size: int) -> DataFrame:
    """The columns `others` as `row`, the text as `bytes`, and what goes of it."""
    spark = prepared(docs.sparkSession)
    key = _key(docs).alias("key")
    source = docs.select(key, F.col("text").cast("binary").alias("text"))
    sketch = spark.sparkContext.broadcast(_sketch(source, size))
    first = source.mapInArrow(lambda batches: _suspects(batches, sketch.value, size), "hash long, key long, at int, upto int")
    alike = first.repartition(F.coalesce("hash", "key")).sortWithinPartitions("hash").mapInArrow(_twice, "key long, at int, upto int")
    runs = alike.groupBy("key").agg(F.collect_list(F.struct("at", "upto")).alias("runs"))
    joined = docs.select(key, F.struct(*(named_column(c) for c in others)).alias("row"), F.col("text").cast("binary").alias("bytes")).join(runs, "key", "left")
    frame = joined.select("row", "bytes", "runs", F.lit(0).alias("n_words"), F.lit(0).alias("n_removed"), F.lit("").alias("kept_sha256"), F.expr("cast(null as binary)").alias("kept"))
    return frame.mapInArrow(lambda batches: _removed(batches, size), frame.schema)


def _key(docs: DataFrame):
    """What names a row: its doc_id where that is an integer, given and unique, as small
    numbers shuffle well; else a hash of doc_id and text."""
    if docs.schema["doc_id"].dataType.simpleString() in ("int", "bigint"):
        if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
            return F.col("doc_id").cast("long")
    return F.xxhash64("doc_id", "text")


def _minimisers(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window its minimiser's value and position, the leftmost among equals."""
    runs = window_hashes(hashes, min(RUN, size))
    span = size - min(RUN, size) + 1
    if len(hashes) < size:
        return runs[:0], np.empty(0, np.int64)
    best, reach = np.arange(len(runs)), 1
    while reach < span:
        step = min(reach, span - reach)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(runs[right] < runs[left], right, left)
        reach += step
    return runs[best], best


def _cells(values: np.ndarray) -> np.ndarray:
    """The counters of each value, one in each row of the sketch."""
    shift = np.uint64(64 - SKETCH_BITS)
    second = (mixed(values * MIX_1) >> shift).astype(np.int64) + (1 << SKETCH_BITS)
    return np.stack([(values >> shift).astype(np.int64), second])


def _sketch(source: DataFrame, size: int) -> np.ndarray:
    """Bits of the counters that reached two: 16 MB at every size of input."""

    def tally(batches):
        hashes, held, many = WordHashes(), [], 0

        def told():
            cells, counts = np.unique(_cells(np.concatenate(held)).ravel(), return_counts=True)
            for at in range(0, len(cells), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(cells[part].astype(np.int32)), pa.array(counts[part])], ["cell", "n"])

        for batch in batches:
            for text in batch.column(1):
                values, places = _minimisers(hashes.of(blank_words(text.as_py())), size)
                if len(values):
                    new = np.concatenate([[True], places[1:] != places[:-1]])
                    held.append(values[new])
                    many += int(new.sum())
            if many > HELD:
                yield from told()
                held, many = [], 0
        if held:
            yield from told()

    counted = source.mapInArrow(tally, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1")
    place = F.col("cell").cast("long") + 1
    maps = counted.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = np.zeros(2 << SKETCH_BITS >> 3, np.uint8)
    for bucket, part in maps.collect():
        bits[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(part, np.uint8)
    return bits


def _suspects(batches, bits: np.ndarray, size: int):
    """Windows estimated repeated. Those seen once by this task, (hash, key, at); for those
    seen more often, (hash) once and the runs of their starts, (key, at, upto)."""
    hashes, held, many = WordHashes(), [], 0

    def told():
        values, keys, ats = (np.concatenate(part) for part in zip(*held))
        order = np.argsort(values, kind="stable")
        ordered = values[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.append(starts, len(ordered)))
        several = np.zeros(len(values), np.bool_)
        several[order] = np.repeat(counts > 1, counts)
        once = ~several
        yield from _rows(values[once], keys[once], ats[once], None)
        known = ordered[starts[counts > 1]]
        yield from _rows(known, None, None, None)
        keys, ats = keys[several], ats[several]
        if len(keys):
            begin = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (ats[1:] != ats[:-1] + 1)]))
            last = np.append(begin[1:], len(keys)) - 1
            yield from _rows(None, keys[begin], ats[begin], ats[last] + 1)

    for batch in batches:
        for key, text in zip(batch.column(0).to_numpy(), batch.column(1)):
            hashed = hashes.of(blank_words(text.as_py()))
            values, _ = _minimisers(hashed, size)
            if not len(values):
                continue
            one, two = _cells(values)
            at = np.flatnonzero(bits[one >> 3] >> (one & 7) & bits[two >> 3] >> (two & 7) & 1)
            if len(at):
                held.append((window_hashes(hashed, size)[at], np.full(len(at), key), at))
                many += len(at)
            if many > HELD:
                yield from told()
                held, many = [], 0
    if held:
        yield from told()


def _rows(values, keys, ats, uptos):
    count = len(next(x for x in (values, keys) if x is not None))
    for low in range(0, count, 100_000):
        part = slice(low, low + 100_000)
        number = min(100_000, count - low)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(number, kind) if x is None else pa.array(x[part].view(np.int64) if kind == pa.int64() else x[part].astype(np.int32)) for x, kind in ((values, pa.int64()), (keys, pa.int64()), (ats, pa.int32()), (uptos, pa.int32()))],
            ["hash", "key", "at", "upto"],
        )


def _twice(batches):
    """Runs settled before pass through. Other rows come sorted by hash: those of a hash
    with more than one row are repeats; at most one row waits for the next batch."""
    carried = None
    for batch in batches:
        open_ = pc.is_valid(batch.column("hash"))
        yield batch.filter(pc.invert(open_)).select(["key", "at", "upto"])
        batch = batch.filter(open_)
        table = pa.table(dict(zip(batch.schema.names, batch.columns)))
        if carried is not None:
            table = pa.concat_tables([carried, table])
        values = table["hash"].to_numpy()
        if not len(values):
            continue
        same = values[1:] == values[:-1]
        told = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        if not told[-1]:
            carried = table.slice(len(values) - 1)
        else:  # the hash may go on in the next batch: keep its row without a place
            carried = pa.table({"hash": values[-1:], "key": pa.nulls(1, pa.int64()), "at": pa.nulls(1, pa.int32()), "upto": pa.nulls(1, pa.int32())})
        out = table.filter(pa.array(told))
        out = out.filter(pc.is_valid(out["key"]))
        ends = pc.add(out["at"], pa.scalar(1, pa.int32()))
        yield from pa.table({"key": out["key"], "at": out["at"], "upto": ends}).to_batches()


def _removed(batches, size: int):
    for batch in batches:
        column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        n_words, n_removed, digests, kept = [], [], [], []
        for text, runs in zip(column["bytes"], column["runs"]):
            words = blank_words(text.as_py())
            n_words.append(len(words))
            if not runs.is_valid:
                n_removed.append(0)
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                kept.append(None)
                continue
            change = np.zeros(len(words) + 1, np.int64)
            flat = runs.values
            np.add.at(change, flat.field("at").to_numpy(), 1)
            np.add.at(change, flat.field("upto").to_numpy() + size - 1, -1)
            keep = np.cumsum(change[:-1]) == 0
            n_removed.append(len(words) - int(keep.sum()))
            digests.append(hashlib.sha256(b" ".join(words[k] for k in np.flatnonzero(keep))).hexdigest())
            edges = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
            whole = text.as_py()
            spans = [m.span() for m in WORD.finditer(whole)] if edges else []
            kept.append(b"\n".join(whole[spans[a][0] : spans[b - 1][1]] for a, b in edges))
        column |= {"n_words": pa.array(n_words, pa.int32()), "n_removed": pa.array(n_removed, pa.int32()), "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(kept, pa.binary())}
        yield pa.RecordBatch.from_arrays(list(column.values()), list(column))
