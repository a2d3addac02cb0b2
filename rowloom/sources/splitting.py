"""Cutting huge text files into records that no line break marks.

The elements of one JSON array, the entries of one JSON object and CSV rows with
quoted line breaks can only be told apart by what precedes them: a comma or line
break counts unless a string is open or nesting is deeper. Reading such a file
whole would put it into one task. Instead:

1. Every file split is summarised on its own: in which string state it ends,
   how far it moves the nesting depth, and how many cut marks it has per depth,
   each for the case that it starts outside a string and inside one.
2. These summaries, one row per split, are summed up in file order. Now the state
   at the start of every split is known.
3. Every split cuts its text. Records inside a split are final; only the pieces
   at its two ends are grouped (by record number) with those of its neighbours.

The record text itself is never shuffled, apart from those end pieces. Where nothing
nests, as in CSV, the first pass knows but for the string state where a split has its
first and last cut, and hands on both ends for either state; then there is no other
pass for them.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import fresh_path
from .scan import BLOCK, FILE, STEP, may_broadcast

_NOT_A_MARK = 9
# An end piece that the first pass hands on has this many bytes at most. A longer one that
# turns out to be needed means one more pass for the ends, as where marks nest.
END_BYTES = 64 * 1024


@dataclass(frozen=True)
class Grammar:
    """Which bytes open (+1), close (-1) or separate (0), and how strings begin:
    at any quote that no backslash escapes, or only after one of ``before_quote``,
    a quote elsewhere outside a string being text."""

    marks: tuple[tuple[str, int], ...]
    start_depth: int
    backslash_escapes: bool
    before_quote: str = ""

    def moves(self) -> np.ndarray:
        table = np.full(256, _NOT_A_MARK, np.int8)
        for mark, move in self.marks:
            table[ord(mark)] = move
        return table

    @property
    def nests(self) -> bool:
        return any(move for _, move in self.marks)


# A cut is any mark at depth 1: the root's brackets and the commas in between.
JSON_ROOT = Grammar((("[", 1), ("{", 1), ("]", -1), ("}", -1), (",", 0)), 0, True)
CSV_ROWS = Grammar((("\n", 0),), 1, False, ",\n")


def _marks(text: np.ndarray, grammar: Grammar, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions and moves of all marks; for both states at the start (outside, inside
    a string) the state at each mark, and the state at the end.

    ``text`` begins where a record may begin: after a separator of the scan."""
    quotes = np.flatnonzero(text == ord('"'))
    closes_only = np.zeros(quotes.size, np.bool_)
    if grammar.backslash_escapes and quotes.size:
        slashes = np.flatnonzero(text == ord("\\"))
        if slashes.size:
            quotes = quotes[_run_before(quotes, slashes) % 2 == 0]
        closes_only = np.zeros(quotes.size, np.bool_)
    elif grammar.before_quote and quotes.size:
        # Runs of an even number leave the state as it is: empty cells, escaped quotes.
        first = np.flatnonzero(np.diff(quotes, prepend=-2) > 1)
        odd = np.diff(np.append(first, quotes.size)) % 2 == 1
        quotes = quotes[first[odd]]
        before = text[np.maximum(quotes - 1, 0)]
        closes_only = (quotes > 0) & ~np.isin(before, np.frombuffer(grammar.before_quote.encode(), np.uint8))
    # A quote toggles the state; one that cannot open a string only closes one. Behind
    # such a quote the state no longer depends on the start.
    toggles = np.cumsum(~closes_only)
    last_close = np.maximum.accumulate(np.where(closes_only, np.arange(quotes.size), -1))
    since = toggles - np.where(last_close >= 0, toggles[np.maximum(last_close, 0)], 0)
    free = (last_close < 0).astype(np.int64)
    after = np.stack([since & 1, (since + free) & 1])
    states = np.concatenate([np.array([[0], [1]]), after], axis=1)
    move = moves[text]
    at = np.flatnonzero(move != _NOT_A_MARK)
    return at, move[at], states[:, np.searchsorted(quotes, at)], states[:, -1]


def _run_before(places: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """How many marked positions stand directly before each place."""
    order = np.arange(marked.size)
    run_start = np.maximum.accumulate(np.where(np.diff(marked, prepend=-2) > 1, order, 0))
    last = np.searchsorted(marked, places) - 1
    touches = (last >= 0) & (marked[last] == places - 1)
    return np.where(touches, last - run_start[last] + 1, 0)


def _levels(move: np.ndarray) -> np.ndarray:
    """Depth, relative to the start, of the container each mark belongs to."""
    return np.cumsum(move) + (move < 0)


def _joined(values: pa.Array, separator: str) -> np.ndarray:
    """The text of a batch, every piece followed by the separator again."""
    kind = pa.large_string()
    ended = pc.binary_join_element_wise(values.cast(kind), pa.scalar("", kind), pa.scalar(separator, kind))
    offsets = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1]
    return np.frombuffer(ended.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]


def _by_split(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Batches cut where a new file split begins."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        changes = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        edges = [0, *changes.tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:], strict=False):
            part = batch.slice(start, end - start)
            yield (part.column(0)[0].as_py(), part.column(1)[0].as_py()), part


_SUMMARY = (
    f"{FILE} bigint, {BLOCK} bigint, ends array<int>, moves array<bigint>, marks array<map<bigint,bigint>>, "
    "pieces array<struct<head:string,tail:string,long:boolean>>"
)
_ARROW_SUMMARY = pa.schema([
    (FILE, pa.int64()), (BLOCK, pa.int64()), ("ends", pa.list_(pa.int32())), ("moves", pa.list_(pa.int64())),
    ("marks", pa.list_(pa.map_(pa.int64(), pa.int64()))),
    ("pieces", pa.list_(pa.struct([("head", pa.string()), ("tail", pa.string()), ("long", pa.bool_())]))),
])


class _Ends:
    """What stands before the first and after the last cut of a split, for one state."""

    def __init__(self) -> None:
        self.head: list[bytes] = []
        self.tail: list[bytes] | None = None  # None: no cut so far, the head goes on
        self.size, self.long = 0, False

    def _add(self, part: list[bytes], data: np.ndarray) -> None:
        self.size += data.size
        if self.size <= END_BYTES:
            part.append(data.tobytes())
        else:
            self.long = True

    def add(self, data: np.ndarray, cuts: np.ndarray) -> None:
        if not cuts.size:
            self._add(self.head if self.tail is None else self.tail, data)
            return
        if self.tail is None:
            self._add(self.head, data[: cuts[0]])
            self.long_head = self.long
        self.tail, self.size, self.long = [], 0, self.long_head
        self._add(self.tail, data[cuts[-1] + 1 :])

    def found(self) -> dict:
        return {"head": _one(b"".join(self.head)), "tail": None if self.tail is None else _one(b"".join(self.tail)), "long": self.long}


def _one(text: bytes) -> str:
    return _as_text(pa.array([text], pa.large_binary()))[0]


def _summarise(grammar: Grammar, separator: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = grammar.moves()
        split, ends, depth, counts, edges = None, [0, 1], [0, 0], [{}, {}], [_Ends(), _Ends()]

        def finished() -> pa.RecordBatch:
            pieces = [[edge.found() for edge in edges]] if not grammar.nests else [None]
            columns = [[split[0]], [split[1]], [ends], [depth], [[list(c.items()) for c in counts]], pieces]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, _ARROW_SUMMARY.types)], schema=_ARROW_SUMMARY)

        for key, batch in _by_split(batches):
            if key != split:
                if split is not None:
                    yield finished()
                split, ends, depth, counts, edges = key, [0, 1], [0, 0], [{}, {}], [_Ends(), _Ends()]
            data = _joined(batch.column(2), separator)
            at, move, states, final = _marks(data, grammar, moves)
            for inside in (0, 1):  # the split starts outside / inside a string
                outside = states[ends[inside]] == 0
                if not grammar.nests:
                    counts[inside][0] = counts[inside].get(0, 0) + int(outside.sum())
                    edges[inside].add(data, at[outside])
                    continue
                chosen = move[outside]
                levels, amounts = np.unique(_levels(chosen) + depth[inside], return_counts=True)
                for level, amount in zip(levels.tolist(), amounts.tolist(), strict=True):
                    counts[inside][level] = counts[inside].get(level, 0) + amount
                depth[inside] += int(chosen.sum(dtype=np.int64))
            ends = [int(final[state]) for state in ends]
        if split is not None:
            yield finished()

    return run


def _starts(summaries: DataFrame, grammar: Grammar, end_depths: Collection[int]) -> DataFrame:
    """State at the start of every split: in a string, depth, cuts so far; and whether
    its file ends in a string or at another depth than one of ``end_depths``, which
    means that it is cut short."""
    ordered = Window.partitionBy(FILE).orderBy(BLOCK)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # A split either keeps or flips the state it starts with, or ends in one all the same.
    outside, within = F.col("ends")[0], F.col("ends")[1]
    flips = summaries.withColumn("flip", ((outside == 1) & (within == 0)).cast("int")).withColumn("so_far", F.sum("flip").over(ordered))
    settled = F.when(outside == within, (outside + F.col("so_far")) % 2)
    known = F.coalesce(F.last(settled, ignorenulls=True).over(before), F.lit(0))
    inside = flips.withColumn("inside", ((known + F.coalesce(F.sum("flip").over(before), F.lit(0))) % 2).cast("int"))
    moved = inside.select(
        FILE, BLOCK, "inside", F.col("moves")[F.col("inside")].alias("move"), F.col("marks")[F.col("inside")].alias("levels"), F.col("ends")[F.col("inside")].alias("end"),
    )
    depth = moved.withColumn("depth", F.coalesce(F.sum("move").over(before), F.lit(0)) + grammar.start_depth)
    cuts = depth.withColumn("cuts", F.coalesce(F.try_element_at("levels", (1 - F.col("depth")).cast("bigint")), F.lit(0)))
    cut_short = (F.last("end").over(whole) == 1) | ~F.sum("move").over(whole).isin(list(end_depths))
    number = F.coalesce(F.sum("cuts").over(before), F.lit(0)).alias("number")
    return cuts.select(FILE, BLOCK, "inside", "depth", number, "cuts", cut_short.alias("cut_short"))


_PIECE = f"{FILE} bigint, {BLOCK} bigint, number bigint, text string, closed boolean"
_ARROW_PIECE = pa.schema([(FILE, pa.int64()), (BLOCK, pa.int64()), ("number", pa.int64()), ("text", pa.string()), ("closed", pa.bool_())])


def _as_text(values: pa.Array) -> pa.Array:
    return pc.cast(values, options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))


def _between(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The texts between neighbouring cuts, taken from the buffer in one go: first
    with the mark that ends them, which is one byte, then without."""
    offsets = pa.py_buffer(np.ascontiguousarray(cuts + 1, np.int64))
    ended = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, offsets, pa.py_buffer(data)])
    return _as_text(pc.binary_slice(ended, 0, -1))


def _cut(grammar: Grammar, separator: str, whole: bool):
    """Cut splits into records: the ``whole`` ones, or the pieces at split ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = grammar.moves()
        split, open_piece, inside, depth, number, is_first = None, [], 0, 0, 0, True

        def rows(texts: pa.Array, first_number: int, closed: bool) -> pa.RecordBatch:
            size = len(texts)
            numbers = pa.array(np.arange(first_number, first_number + size, dtype=np.int64))
            constants = [pa.repeat(pa.scalar(value, kind), size) for value, kind in zip((*split, closed), (pa.int64(), pa.int64(), pa.bool_()), strict=True)]
            return pa.RecordBatch.from_arrays([*constants[:2], numbers, texts, constants[2]], schema=_ARROW_PIECE)

        def one(text: bytes) -> pa.Array:
            return _as_text(pa.array([text], pa.large_binary()))

        for key, batch in _by_split(batches):
            if key != split:
                if split is not None and not whole:
                    yield rows(one(b"".join(open_piece)), number, False)
                split, open_piece, is_first = key, [], True
                inside, depth, number = (batch.column(c)[0].as_py() for c in (3, 4, 5))
            data = _joined(batch.column(2), separator)
            at, move, states, final = _marks(data, grammar, moves)
            outside = states[inside] == 0
            at, move = at[outside], move[outside]
            cuts = at[_levels(move) + depth == 1]
            inside = int(final[inside])
            depth += int(move.sum(dtype=np.int64))
            if not cuts.size:
                open_piece.append(data.tobytes())
                continue
            # The first piece of a split belongs to a record begun in an earlier one.
            if whole != is_first:
                yield rows(one(b"".join(open_piece) + data[: cuts[0]].tobytes()), number, True)
            if whole and cuts.size > 1:
                yield rows(_between(data, cuts), number + 1, True)
            number, open_piece, is_first = number + int(cuts.size), [data[cuts[-1] + 1 :].tobytes()], False
        if split is not None and not whole:
            yield rows(one(b"".join(open_piece)), number, False)

    return run


def _handed_on(summaries: DataFrame, starts: DataFrame) -> DataFrame | None:
    """The pieces at split ends as the first pass found them, or None if one is too long."""
    chosen = F.col("pieces")[F.col("inside")]
    known = starts.select(FILE, BLOCK, "inside", "number", "cuts")
    found = summaries.select(FILE, BLOCK, "pieces").join(known, [FILE, BLOCK]).select(FILE, BLOCK, "number", "cuts", chosen.alias("piece"))
    if not found.where("piece.long").isEmpty():
        return None
    head = F.struct(F.col("number"), F.col("piece.head").alias("text"), (F.col("cuts") > 0).alias("closed"))
    tail = F.struct((F.col("number") + F.col("cuts")).alias("number"), F.col("piece.tail").alias("text"), F.lit(False).alias("closed"))
    return found.select(FILE, BLOCK, F.explode(F.array(head, tail)).alias("end")).select(FILE, BLOCK, "end.*").where("text is not null")


# A table of file names and keys of at most this many rows, some 300 bytes each, may be broadcast.
MAX_BROADCAST_FILES = 2_000_000


def _file_key(path: Column, salt: int) -> Column:
    return F.xxhash64(path, F.lit(salt))


def _file_names(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, int, int]:
    """(file, key) per file, the salt that makes the keys unique, and the number
    of files. A key stands in for the name next to every piece of text; only file
    names are read here."""
    names = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("file"))
    amount, salt = len(names.inputFiles()), 0
    while amount > 1:
        found = names.agg(F.count(F.lit(1)).alias("files"), F.count_distinct(_file_key(F.col("file"), salt)).alias("keys")).first()
        if found["files"] == found["keys"]:
            break
        salt += 1
    return names.withColumn(FILE, _file_key(F.col("file"), salt)), salt, amount


def split_records(
    spark: SparkSession, path: str | list[str], grammar: Grammar, separator: str, with_file: bool = True, on_damage: str = "fail",
    root: str = "",
) -> DataFrame:
    """(file, number, text): the stretches between cut marks, numbered per file.

    ``separator`` is what the text source is cut at when it is read; any byte that
    turns up often enough and never follows a backslash will do.

    ``on_damage``: a file that ends inside a string or inside brackets fails the run
    ("fail"), or what follows its last cut mark is a stretch as well ("row"). ``root``:
    the bracket that closes the document, where there is one.
    """
    if on_damage not in ("fail", "row"):
        raise ValueError(f"Unknown on_damage '{on_damage}'.")
    paths = [path] if isinstance(path, str) else list(dict.fromkeys(path))
    names, salt, files = _file_names(spark, paths)
    pieces = spark.read.option("lineSep", separator).text(paths).select(
        _file_key(F.col("_metadata.file_path"), salt).alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        "value",
        F.monotonically_increasing_id().alias(STEP),
    )
    summaries = pieces.select(FILE, BLOCK, "value").mapInArrow(_summarise(grammar, separator), _SUMMARY)
    if not grammar.nests:  # they are read twice: for the states, and for the ends
        folder = fresh_path(spark, "summaries")
        summaries.write.parquet(folder)
        summaries = spark.read.schema(_SUMMARY).parquet(folder)
    # A separator is put after the last piece as well, unless the file ends with one.
    added = dict(grammar.marks).get(separator, 0)
    starts = _starts(summaries, grammar, {0, added} if root == separator else {added})
    if on_damage == "fail":
        failure = F.raise_error("A file ends inside a string or inside brackets.").cast("boolean")
        starts = starts.where(F.when(F.col("cut_short"), failure).otherwise(True))
    columns = [FILE, BLOCK, "value", "inside", "depth", "number"]
    if may_broadcast(pieces):
        placed = pieces.join(F.broadcast(starts), [FILE, BLOCK]).select(columns)
    else:
        # Too many splits to broadcast: a shuffle join, then splits put back in order.
        joined = pieces.join(starts, [FILE, BLOCK]).repartition(FILE, BLOCK)
        placed = joined.sortWithinPartitions(FILE, BLOCK, STEP).select(columns)
    inner = placed.mapInArrow(_cut(grammar, separator, whole=True), _PIECE)
    ends = _handed_on(summaries, starts) if not grammar.nests else None
    if ends is None:
        ends = placed.mapInArrow(_cut(grammar, separator, whole=False), _PIECE)
    stitched = ends.groupBy(FILE, "number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(BLOCK, "text"))), lambda p: p["text"]), "").alias("text"),
        F.bool_or("closed").alias("closed"),
    )
    complete = "closed" if on_damage == "fail" else r"closed or not rlike(text, '^[ \\t\\r\\n]*$')"
    records = inner.select(FILE, "number", "text").unionByName(stitched.where(complete).select(FILE, "number", "text"))
    if not with_file:
        return records.select("number", "text")
    named = records.join(F.broadcast(names) if files <= MAX_BROADCAST_FILES else names, FILE)
    return named.select("file", "number", "text")
