"""Tokens of documents packed into sequences of a fixed capacity, by sums of squares.

Each task turns texts into token ids and cuts documents longer than a sequence. The pieces are
dealt at random into groups of some `GROUP` pieces, each packed by one task, long pieces first:
a piece goes where the sum, over residual gaps, of the squared number of open sequences with
that gap becomes smallest, of equal places into the one with least room left, and into a new
sequence only if none has room. Only the counts by gap matter for that, so a step costs the
capacity at most, however many sequences are open.

Sequences that a group leaves with much room are taken apart and their pieces packed again with
those of other groups, until one group holds them all or this no longer helps.
"""

from __future__ import annotations

import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .frames import cut, texts

CAPACITY, END, GROUP, HELD, TOGETHER = 4096, 1, 32_768, 900_000, 12
#: Sequences with more than this share of their capacity left are packed again.
ROOM = 1 / 64
#: A mark that closes a word, after a letter or digit. Letters: ASCII and U+00C0 to U+023F and
#: U+0400 to U+047F by their two bytes, but for two signs and one that gets a mark in lower case.
CLOSING = re.compile(rb"[.,;:!?*$%&#](?:(?<=[0-9A-Za-z].)|(?<=[\xc3-\xc8\xd0\xd1][\x80-\xbf].)(?<!\xc3[\x97\xb7].)(?<!\xc4\xb0.))")
#: Words already turned into ids by this worker, by vocabulary; one at a time.
_known: dict[str, "WordIds"] = {}


class WordIds(dict):
    """Word -> its ids as little-endian bytes, for at most `HELD` words between batches.

    Closing marks after a letter or digit are pieces of their own for the tokenizer, so `words`
    parts them; it makes ASCII letters lower case if the tokenizer does. Some words at a time go
    through it as one text, with one of its special tokens between them, as it takes what lies
    between such tokens apart from the rest; ASCII letters with blanks between. Texts that share
    a sign with the ends of that token are left as they are, and such words go alone."""

    def __init__(self, vocabulary: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.lowers = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("A") == "a"
        plain = ((i, t.content) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized))
        self.between, token = next(plain, (-1, ""))
        self.token = token.encode()
        # Where the last token of a run of letters shows by its suffix, runs need no token between.
        suffix, self.closes = getattr(self.tokenizer.model, "end_of_word_suffix", None), None
        if suffix:
            self.closes = np.zeros(self.tokenizer.get_vocab_size(), np.bool_)
            self.closes[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def _apart(self, text: bytes) -> bool:
        return self.token[:1] in text or self.token[-1:] in text

    def words(self, text: bytes | None) -> list[bytes]:
        if not text or self._apart(text):
            return text.split() if text else []
        # Only the marks from U+0300 to U+036F ever join an ASCII letter before them.
        if self.lowers and b"\xcc" not in text and b"\xcd" not in text:
            text = text.lower()
        return CLOSING.sub(rb" \g<0>", text).split()

    def learn(self, words: set[bytes]) -> None:
        if len(self) > HELD:
            self.clear()
        new = words.difference(self)
        runs = [word for word in new if word.isalpha()] if self.closes is not None else []
        self._take(runs, b" ", lambda ids: np.flatnonzero(self.closes[ids]) + 1, 0)
        rest = new.difference(runs)
        alone = [word for word in rest if self._apart(word)]
        self._take(list(rest.difference(alone)), self.token, lambda ids: np.append(np.flatnonzero(ids == self.between), len(ids)), 1)
        for word, encoding in zip(alone, self._encoded(alone)):
            self[word] = np.array(encoding.ids, "<u4").tobytes()

    def _take(self, new: list[bytes], between: bytes, ends_of, skip: int) -> None:
        """Look up `new`, some in one text; `ends_of` tells where the ids of each end, of which
        `skip` are left out after it."""
        groups = [new[low : low + TOGETHER] for low in range(0, len(new), TOGETHER)]
        for group, encoding in zip(groups, self._encoded(between.join(group) for group in groups)):
            ids = np.array(encoding.ids, "<u4")
            data, begin = ids.tobytes(), 0
            for part, end in zip(group, ends_of(ids).tolist(), strict=True):
                self[part] = data[4 * begin : 4 * end]
                begin = end + skip

    def _encoded(self, texts):
        return self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace") for text in texts], add_special_tokens=False)


def ids_by_word(vocabulary: str) -> WordIds:
    """The table of this worker, which outlives its tasks."""
    if vocabulary not in _known:
        _known.clear()
        _known[vocabulary] = WordIds(vocabulary)
    return _known[vocabulary]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document of `docs` (doc_id, text): doc_id, piece (from 0), start,
    length, ids_crc32 and a number `row` of its own; with `with_ids` also its ids.

    `vocabulary` is the content of a tokenizer file that has a special token and whose tokens
    span neither ASCII white space nor a letter and a mark after it: words go through it apart,
    see `WordIds`. `end` closes every document, so
    null and empty texts have one piece of one token. Documents longer than `capacity` are cut
    every `capacity` tokens. Repeated rows are documents of their own; an empty table has no
    pieces; other columns are not read."""
    source = texts(docs)
    sent = source.sparkSession.sparkContext.broadcast(vocabulary)
    last = int(end).to_bytes(4, "little")

    def run(batches):
        table = ids_by_word(sent.value)
        for batch in batches:
            documents = [table.words(text.as_py()) for text in batch.column(1)]
            table.learn(set().union(*documents))
            rows: list[tuple] = []
            held = 0
            for doc_id, words in zip(batch.column(0).to_pylist(), documents):
                ids = b"".join(map(table.__getitem__, words)) + last
                for number, first in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[first : first + 4 * capacity]
                    rows.append((doc_id, number, first // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None))
                    held += len(part)
                if with_ids and held > 4_000_000:
                    yield packed(rows, batch.schema.field(0).type)
                    rows, held = [], 0
            if rows:
                yield packed(rows, batch.schema.field(0).type)

    def packed(rows, id_type):
        columns = list(zip(*rows))
        kinds = [id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        count = len(names) if with_ids else len(names) - 1
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns[:count], kinds)], names[:count])

    added = "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    found = source.mapInArrow(run, StructType([source.schema["doc_id"], *StructType.fromDDL(added).fields]))
    return cut(found.withColumn("row", F.monotonically_increasing_id()), "pieces")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece, in the order given: its sequence and its offset there; and what room
    each sequence has left."""
    counts = np.zeros(capacity + 1, np.int64)
    open_with: dict[int, list[int]] = {}
    sequence, offset, room = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for at, length in enumerate(lengths.tolist()):
        fits = np.flatnonzero(counts[length:])
        if len(fits):
            # One sequence fewer with the gap it had, one more with the gap that is left:
            # the sum of squares changes by 2 (left - had) + 2. Full ones are not open.
            change = 2 * (counts[fits] - counts[fits + length]) + 2
            if fits[0] == 0:
                change[0] -= 1
            left = int(fits[change.argmin()])
            number = open_with[left + length].pop()
            counts[left + length] -= 1
        else:
            left, number = capacity - length, len(room)
            room.append(0)
        sequence[at], offset[at] = number, capacity - length - left
        room[number] = left
        if left:
            counts[left] += 1
            open_with.setdefault(left, []).append(number)
    return sequence, offset, np.array(room, np.int64)


def pack(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """`parts` (row, length and whatever else, but without ids) with sequence_id and offset.

    Every piece is placed in one sequence, gapless from offset 0; `length` is from 1 to
    `capacity`. `row` tells pieces apart. A group is some `group` pieces by a hash of `row`, so
    neither equal lengths nor copies of one document meet in one task. Columns named
    sequence_id, offset, packing_group, bin or gap must not be among those of `parts`."""
    names = parts.columns
    schema = StructType([*parts.schema.fields, *(StructField(n, LongType()) for n in ("packing_group", "bin", "offset", "gap"))])

    def place(table):
        table = table.sort_by([("length", "descending"), ("row", "ascending")])
        sequence, offset, room = sum_of_squares(table["length"].to_numpy(), capacity)
        for name, values in (("bin", sequence), ("offset", offset), ("gap", room[sequence])):
            table = table.append_column(name, pa.array(values))
        return table

    done, rest, turn = [], parts, 0
    count = rest.count()
    while True:
        groups = max(1, math.ceil(count / group))
        numbered = rest.withColumn("packing_group", F.pmod(F.xxhash64(F.lit(turn), "row"), F.lit(groups)))
        placed = cut(numbered.groupBy("packing_group").applyInArrow(place, schema), "packed")
        number = F.lit(turn << 56) + F.col("packing_group") * (1 << 20) + F.col("bin")
        result = placed.withColumn("sequence_id", number).select(*names, "sequence_id", "offset")
        loose = F.col("gap") > int(capacity * ROOM)
        left = placed.where(loose).count() if groups > 1 else 0
        if not left or left > count / 2:
            done.append(result)
            break
        done.append(placed.where(~loose).withColumn("sequence_id", number).select(*names, "sequence_id", "offset"))
        rest, count, turn = placed.where(loose).select(*names), left, turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def sequences(placed: DataFrame, parts: DataFrame) -> DataFrame:
    """sequence_id, ids (of at most one capacity) and documents (doc_id, start, offset, length
    in order) of every sequence; `parts` are the pieces with their ids."""
    rows = placed.join(parts.select("row", "ids"), "row")
    found = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("found"))
    documents = F.transform("found", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["offset"].alias("offset"), x["length"].alias("length")))
    return found.select("sequence_id", F.flatten("found.ids").alias("ids"), documents.alias("documents"))
