"""Scoring texts with a class-based bigram model over all words of a corpus.

Words are counted over the whole training corpus, in Spark. Of these counts only a head of
fixed size (`head` words) is sent to the tasks; rarer words meet their count and their
class in a join. Every word has a class of its own, found by exchange clustering in three
steps, each of which looks at all training texts:

* The `FREQUENT` most frequent words, and the endings of all others, are clustered one by
  one over the table of their bigrams, until none moves.
* The `SWEPT` most frequent words are exchanged in parallel sweeps (Uszkoreit and Brants,
  2008): Spark counts each word's neighbours by class, and each word goes where it raises
  the likelihood most if all others stay. Sweeps end when the information that a class
  tells of the next one grows by less than a 500th.
* Each further word, rare or not, goes to the class that its neighbours make most likely.
  Neighbours outside the sweeps stand in the class of their ending meanwhile.

Then P(word | before) = P(class | class before) * P(word | class), with smoothing in both
factors. Only words never seen in training take the class of their ending; one unseen word
is left room for in every ending.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut, texts

HEAD, SWEPT, FREQUENT, ENDINGS, CLASSES, HELD, STRENGTH = 131_072, 16_384, 512, 512, 64, 200_000, 5.0
TYPES = FREQUENT + ENDINGS + 1
#: What each word's count gets added inside its class, and what an unseen word counts.
ROOM = 0.5
#: Sweeps go on while the information between neighbouring classes grows by this share.
RISE = 0.002
#: Words in one row of neighbour counts, counts of a word, and groups that add up rows first.
BLOCK, WIDTH, SALTS = 64, 2 * CLASSES + 1, 8


def ending(word: bytes) -> int:
    """Which of the endings a word has: a hash of its last three bytes."""
    return xxhash.xxh3_64_intdigest(word[-3:]) % ENDINGS


class Codes:
    """Word -> place in the head, or the head's size plus its ending."""

    def __init__(self, head: list[bytes]):
        self.head, self.size = pa.array(head, pa.binary()), len(head)

    def of(self, words: pa.Array | list[bytes]) -> np.ndarray:
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
        code = np.array(pc.fill_null(pc.index_in(words, value_set=self.head), -1), np.int32)
        rare = np.flatnonzero(code < 0)
        tails = pc.binary_slice(words.take(pa.array(rare)), -3).dictionary_encode()
        endings = np.array([ending(tail) for tail in tails.dictionary.to_pylist()], np.int32)
        code[rare] = self.size + endings[tails.indices.to_numpy()]
        return code


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (bytes) of a batch in one row, A-Z in lower case, and where
    those of each text begin, with the end of the last."""
    # Only ASCII bytes are looked at, so the text need not be valid.
    shown = pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), offset=texts.offset)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(shown, "")))
    words, starts = lists.flatten().cast(pa.binary()), lists.offsets.to_numpy().astype(np.int64)
    # White space at an end of a text leaves an empty word there.
    filled = np.array(pc.greater(pc.binary_length(words), 0), np.bool_)
    if not filled.all():
        words, starts = words.filter(pa.array(filled)), np.concatenate([[0], np.cumsum(filled)])[starts]
    return words, starts


def added_up(tables: list[pa.Table], keys: list[str]) -> pa.Table:
    """The tables as one, in which `n` is summed up by `keys`."""
    found = pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("n", "sum")])
    return found.select([*keys, "n_sum"]).rename_columns([*keys, "n"])


@dataclass
class Model:
    head: list[bytes]
    head_counts: np.ndarray
    tokens: int  # N, with ends
    distinct: int  # V, with the end
    ends: int
    classes: np.ndarray  # class of each word of the head, then of each ending, then of the end
    steps: np.ndarray  # log10 P(class | class before)
    rooms: np.ndarray  # of each class: log10 of what the counts in it are divided by


def word_counts(training: DataFrame) -> DataFrame:
    """(word, n) over all training texts (text as bytes)."""

    def tally(batches):
        seen, many = [], 0
        for batch in batches:
            found = pc.value_counts(split_words(batch.column(0))[0])
            seen.append(pa.Table.from_arrays(found.flatten(), ["word", "n"]))
            many += len(found)
            if many > HELD:
                seen = [added_up(seen, ["word"])]
                many = len(seen[0])
            if many > HELD:
                yield from seen[0].to_batches(50_000)
                seen, many = [], 0
        if seen:
            yield from added_up(seen, ["word"]).to_batches(50_000)

    return training.select("text").mapInArrow(tally, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, head: int) -> tuple[list[bytes], np.ndarray]:
    """The `head` most frequent words, ties by word, and their counts. How many words have
    each count tells the least count that belongs; only words of that count are ordered."""
    per = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.col("n").desc()).limit(head).collect()
    room, least = head, None
    for row in per:
        if row["words"] > room:
            least = row["n"]
            break
        room -= row["words"]
    certain = counts if least is None else counts.where(F.col("n") > least)
    if least is None and len(per) == head:
        certain = counts.where(F.col("n") >= per[-1]["n"])
    if least is not None and room:
        certain = certain.union(counts.where(F.col("n") == least).orderBy("word").limit(room))
    found = certain.toArrow().to_pydict()
    order = sorted(zip(found["n"], found["word"]), key=lambda pair: (-pair[0], pair[1]))
    return [word for _, word in order], np.array([n for n, _ in order], np.int64)


def weighed(x):
    return x * np.log(np.maximum(x, 1.0))


def information(table: np.ndarray) -> float:
    """What a class tells of the next one, in nats a token."""
    total = max(table.sum(), 1.0)
    return float(weighed(table).sum() - weighed(table.sum(0)).sum() - weighed(table.sum(1)).sum() + weighed(total)) / total


def gains(table: np.ndarray, right: np.ndarray, left: np.ndarray, both: float) -> np.ndarray:
    """By how much the likelihood of the class bigrams `table` rises if a word goes to each
    class. `right` and `left` are the classes after and before it, `both` counts the word
    next to itself; none of these is in the table. Class 0 belongs to the end of a text."""
    f = weighed
    rows, columns, diagonal = table.sum(1), table.sum(0), np.diagonal(table)
    gain = (f(table + right) - f(table)).sum(1) + (f(table + left[:, None]) - f(table)).sum(0)
    gain += f(diagonal + right + left + both) - f(diagonal + right) - f(diagonal + left) + f(diagonal)
    gain -= f(rows + right.sum() + both) - f(rows) + f(columns + left.sum() + both) - f(columns)
    gain[0] = -np.inf
    return gain


def better(table: np.ndarray, own: int, right: np.ndarray, left: np.ndarray, both: float) -> int:
    """Where a word of class `own` goes, if all others stay. Changes `table`: the word is taken out.
    A gain below the rounding error of the sums is none, so no word moves to and fro."""
    least = 1e-9 + 1e-12 * weighed(table.sum())
    right[own] -= both
    left[own] -= both
    table[own] -= right
    table[:, own] -= left
    table[own, own] -= both
    gain = gains(table, right, left, both)
    best = int(gain.argmax())
    return best if gain[best] > gain[own] + least else own


def nearest(table: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The class of the largest gain for each row of `right` and `left`: many words that are
    not in the table and few of whose neighbours differ."""
    gain = np.zeros(right.shape)
    for counts, cells in ((right, np.ascontiguousarray(table.T)), (left, table)):
        word, beside = np.nonzero(counts)
        if not len(word):
            continue
        number = counts[word, beside]
        more = (weighed(cells + 1) - weighed(cells))[beside]
        many = np.flatnonzero(number > 1)
        at = cells[beside[many]]
        more[many] = weighed(at + number[many, None]) - weighed(at)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        gain[word[first]] += np.add.reduceat(more, first, axis=0)
    word, own = np.nonzero((right > 0) & (left > 0))
    cell, r, l = np.diagonal(table)[own], right[word, own], left[word, own]
    gain[word, own] += weighed(cell + r + l) - weighed(cell + r) - weighed(cell + l) + weighed(cell)
    for marginal, number in ((table.sum(1), right.sum(1)), (table.sum(0), left.sum(1))):
        gain -= weighed(marginal + number[:, None]) - weighed(marginal)
    gain[:, 0] = -np.inf
    return gain.argmax(1)


def exchange(bigrams: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """The class of each type, by exchange clustering of a table of type bigrams, one type
    after the other until none moves; each move raises the likelihood.

    The last type, the end of a text, keeps class 0 for itself."""
    count = len(bigrams)
    weight = bigrams.sum(0) + bigrams.sum(1)
    order = np.argsort(-weight[:-1], kind="stable")
    of = np.zeros(count, np.int64)
    of[order] = 1 + np.arange(count - 1) % (classes - 1)
    member = np.zeros((count, classes))
    member[np.arange(count), of] = 1
    after, before = bigrams @ member, bigrams.T @ member  # of each type: classes that follow, that precede
    table = member.T @ after
    moved = True
    while moved:
        moved = False
        for w in order.tolist():
            if not weight[w]:
                continue
            own, both = of[w], bigrams[w, w]
            right, left = after[w].copy(), before[w].copy()
            best = better(table, own, right, left, both)
            table[best] += right
            table[:, best] += left
            table[best, best] += both
            if best != own:
                moved = True
                of[w] = best
                after[:, own] -= bigrams[:, w]
                after[:, best] += bigrams[:, w]
                before[:, own] -= bigrams[w]
                before[:, best] += bigrams[w]
    return of


def _outside(code: np.ndarray, starts: np.ndarray, size: int, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Places of the words outside the head, and these words in a list for each text."""
    at = np.flatnonzero(code >= size)
    return at, pa.ListArray.from_arrays(pa.array(np.searchsorted(at, starts).astype(np.int32)), words.take(pa.array(at)))


def coded(source: DataFrame, sent) -> DataFrame:
    """Each text as the codes of its words and the end, and its words outside the head."""

    def run(batches):
        codes = Codes(sent.value)
        for batch in batches:
            words, starts = split_words(batch.column(0))
            code = codes.of(words)
            stream = np.insert(code, starts[1:], codes.size + ENDINGS)
            places = ((starts + np.arange(len(starts))) * 4).astype(np.int32)
            paths = pa.Array.from_buffers(pa.binary(), len(batch.column(0)), [None, pa.py_buffer(places), pa.py_buffer(stream)])
            yield pa.RecordBatch.from_arrays([paths, _outside(code, starts, codes.size, words)[1]], ["codes", "rare"])

    return cut(source.select("text").mapInArrow(run, "codes binary, rare array<binary>"), "coded")


def _stream(batch, end: int) -> np.ndarray:
    """The codes of all texts of a batch in one row, an end before each and after the last."""
    return np.concatenate([np.array([end], np.int32), np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)])


def _counted(paths: DataFrame, place, width: int) -> np.ndarray:
    """How often each value below `width` of place(stream) occurs: a table of fixed size."""

    def run(batches):
        table = np.zeros(width, np.int64)
        for batch in batches:
            table += np.bincount(place(batch), minlength=width)
        at = np.flatnonzero(table)
        for low in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[low : low + 100_000]), pa.array(table[at[low : low + 100_000]])], ["place", "n"])

    found = paths.select("codes").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(width)
    table[found["place"].to_numpy()] = found["n"].to_numpy()
    return table


def _bigrams(paths: DataFrame, of: np.ndarray, kinds: int) -> np.ndarray:
    """How often each two kinds of words stand side by side."""
    end, sent = len(of) - 1, paths.sparkSession.sparkContext.broadcast(of)

    def place(batch):
        kind = sent.value[_stream(batch, end)]
        return kind[:-1] * kinds + kind[1:]

    return _counted(paths, place, kinds * kinds).reshape(kinds, kinds)


def _neighbours(paths: DataFrame, classes: np.ndarray, swept: int) -> DataFrame:
    """(block, counts): for BLOCK words each, the classes after a word, the classes before it
    and the word next to itself, WIDTH counts a word; as block -1, the class bigrams.

    A task sends one row a block. Rows are added up in two steps, so that no task adds up
    all rows of a block where there are very many tasks."""
    end = len(classes) - 1
    sent = paths.sparkSession.sparkContext.broadcast(classes)

    def run(batches):
        table, bigrams, salt = np.zeros(-(-swept // BLOCK) * BLOCK * WIDTH, np.int64), np.zeros(CLASSES * CLASSES, np.int64), 0
        for batch in batches:
            stream = _stream(batch, end)
            of = sent.value[stream]
            bigrams += np.bincount(of[:-1] * CLASSES + of[1:], minlength=len(bigrams))
            first, second = stream[:-1].astype(np.int64), stream[1:].astype(np.int64)
            one, two = first < swept, second < swept
            for places in (first[one] * WIDTH + of[1:][one], second[two] * WIDTH + CLASSES + of[:-1][two], first[one & (first == second)] * WIDTH + 2 * CLASSES):
                np.add.at(table, places, 1)
            salt = (salt * 31 + int(bigrams.sum())) % SALTS
        yield from rows(np.arange(-1, swept / BLOCK, dtype=np.int64).tolist(), salt, [bigrams, *table.reshape(-1, BLOCK * WIDTH)])

    def rows(blocks, salt, counts):
        for low in range(0, len(blocks), 64):
            part = blocks[low : low + 64]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([salt] * len(part), pa.int32()), pa.array([c.tobytes() for c in counts[low : low + 64]], pa.binary())], ["block", "salt", "counts"])

    def added(batches):
        block, total = None, None
        for batch in batches:
            for new, counts in zip(batch.column(0).to_pylist(), batch.column(2)):
                counts = np.frombuffer(counts.as_py(), np.int64)
                if new != block:
                    if block is not None:
                        yield from rows([block], 0, [total])
                    block, total = new, counts.copy()
                else:
                    total += counts
        if block is not None:
            yield from rows([block], 0, [total])

    kind = "block int, salt int, counts binary"
    salted = paths.select("codes").mapInArrow(run, kind).repartition("block", "salt").sortWithinPartitions("block").mapInArrow(added, kind)
    return cut(salted.repartition("block").sortWithinPartitions("block").mapInArrow(added, kind), "neighbours")


def _moves(neighbours: DataFrame, table: np.ndarray, classes: np.ndarray, swept: int) -> DataFrame:
    """(code, class) of the swept words."""
    sent = neighbours.sparkSession.sparkContext.broadcast((table, classes))

    def run(batches):
        table, classes = sent.value
        for batch in batches:
            codes, to = [], []
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                lines = np.frombuffer(counts.as_py(), np.int64).reshape(BLOCK, WIDTH).astype(float)
                for code, line in zip(range(block * BLOCK, min(swept, (block + 1) * BLOCK)), lines):
                    codes.append(code)
                    to.append(better(table.copy(), int(classes[code]), line[:CLASSES], line[CLASSES:-1], line[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), pa.array(to, pa.int32())], ["code", "class"])

    blocks = neighbours.where("block >= 0").select("block", "counts")
    return blocks.repartition(neighbours.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "code int, class int")


def sweep(paths: DataFrame, classes: np.ndarray, swept: int) -> np.ndarray:
    """The classes after parallel exchange of the first `swept` words."""
    known, best = 0.0, classes
    while swept:
        neighbours = _neighbours(paths, classes, swept)
        counts = neighbours.where("block = -1").select("counts").collect()
        table = np.frombuffer(counts[0]["counts"], np.int64).reshape(CLASSES, CLASSES).astype(float) if counts else np.zeros((CLASSES, CLASSES))
        told = information(table)
        if told > known:
            best = classes
        if not told or told <= known * (1 + RISE):
            break
        known = told
        moves = _moves(neighbours, table, classes, swept).toArrow()
        classes = classes.copy()
        classes[moves["code"].to_numpy()] = moves["class"].to_numpy()
    return best


def further(paths: DataFrame, classes: np.ndarray, swept: int) -> DataFrame:
    """(code, word, n, class) of each word outside the sweeps: the code of those in the
    head, the word of others. A task tells how often it met each word between two classes;
    the rows of a word meet sorted, and no more than some thousands of them are held."""
    end, size = len(classes) - 1, len(classes) - 1 - ENDINGS
    sent = paths.sparkSession.sparkContext.broadcast((_bigrams(paths, classes, CLASSES), classes))

    def beside(batches):
        classes, seen, fresh, held, many = sent.value[1], [], 0, [], 0

        def told():
            if held:
                keys, counts = np.unique(np.concatenate(held), return_counts=True)
                for low in range(0, len(keys), 50_000):
                    key = keys[low : low + 50_000]
                    yield rows(pa.array((key >> 12).astype(np.int32)), pa.nulls(len(key), pa.binary()), key & 4095, counts[low : low + 50_000])
            for part in added_up(seen, ["word", "pair"]).to_batches(50_000) if seen else ():
                yield rows(pa.nulls(len(part), pa.int32()), part["word"], part["pair"].to_numpy(), part["n"].to_numpy())

        def rows(code, word, pair, n):
            return pa.RecordBatch.from_arrays([code, word, pa.array(pair.astype(np.int16)), pa.array(n.astype(np.int64))], ["code", "word", "pair", "n"])

        for batch in batches:
            stream = _stream(batch, end)
            of = np.append(classes[stream], 0)
            pair, code = (of[:-2] << 6 | of[2:]), stream[1:].astype(np.int64)
            middle = (code >= swept) & (code < size)
            held.append(code[middle] << 12 | pair[middle])
            many += int(middle.sum())
            rare = batch.column(1).flatten()
            seen.append(added_up([pa.Table.from_arrays([rare, pa.array(pair[(code >= size) & (code < end)].astype(np.int16)), pa.array(np.ones(len(rare), np.int64))], ["word", "pair", "n"])], ["word", "pair"]))
            fresh += len(seen[-1])
            if fresh > HELD:
                seen = [added_up(seen, ["word", "pair"])]
                fresh = len(seen[0])
            if many > 2_000_000 or fresh > HELD:
                yield from told()
                seen, fresh, held, many = [], 0, [], 0
        yield from told()

    def settled(batches):
        table, waiting = sent.value[0], None
        for batch in batches:
            rows = pa.Table.from_batches([batch]).select(["code", "word", "pair", "n"])
            rows = rows if waiting is None else pa.concat_tables([waiting, rows])
            if not len(rows):
                continue
            first = starts(rows)
            yield from decided(rows.slice(0, first[-1]), first[:-1], table)
            waiting = rows.slice(first[-1])  # the last word may go on in the next batch
            if len(waiting) > 4 * CLASSES**2:
                number = np.bincount(waiting["pair"].to_numpy(), waiting["n"].to_numpy()).astype(np.int64)
                pairs = np.flatnonzero(number)
                waiting = waiting.slice(0, len(pairs)).set_column(2, "pair", pa.array(pairs.astype(np.int16))).set_column(3, "n", pa.array(number[pairs]))
        if waiting is not None:
            yield from decided(waiting, np.array([0]), table)

    def starts(rows):
        code = pc.fill_null(rows["code"], -1).to_numpy()
        word = pc.fill_null(rows["word"], b"").combine_chunks().dictionary_encode().indices.to_numpy()
        return np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (word[1:] != word[:-1])]))

    def decided(rows, first, table):
        pair, n = rows["pair"].to_numpy().astype(np.int64), rows["n"].to_numpy()
        ends = np.append(first[1:], len(rows))
        for low in range(0, len(first), 512):
            begin, stop = first[low], ends[min(low + 512, len(first)) - 1]
            part = first[low : low + 512]
            word = np.repeat(np.arange(len(part)), ends[low : low + 512] - part)
            right, left = np.zeros((len(part), CLASSES)), np.zeros((len(part), CLASSES))
            np.add.at(right, (word, pair[begin:stop] & 63), n[begin:stop])
            np.add.at(left, (word, pair[begin:stop] >> 6), n[begin:stop])
            named = rows.select(["code", "word"]).take(pa.array(part))
            out = named.append_column("n", pa.array(right.sum(1).astype(np.int64))).append_column("class", pa.array(nearest(table, right, left).astype(np.int32)))
            yield from out.combine_chunks().to_batches()

    place = F.coalesce(F.col("code").cast("long"), F.xxhash64("word")).alias("place")  # quickly sorted
    tallied = paths.mapInArrow(beside, "code int, word binary, pair short, n long").select(place, "code", "word", "pair", "n")
    return tallied.repartition("place").sortWithinPartitions("place", "word").select("code", "word", "pair", "n").mapInArrow(settled, "code int, word binary, n long, class int")


def learn(training: DataFrame, head: int = HEAD, swept: int = SWEPT, frequent: int = FREQUENT) -> tuple[Model, DataFrame]:
    """The model, and (word, n, class) of all words outside its head.

    Without a training text every count is 0 and all words have equal chances."""
    source = texts(training)
    counts = cut(word_counts(source.select("text")), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words, numbers = most_frequent(counts, head)
    paths = coded(source, training.sparkSession.sparkContext.broadcast(words))
    ends = paths.count()
    size, swept, frequent = len(words), min(swept, len(words)), min(frequent, len(words))

    # Types of the seed: frequent words, endings, the end.
    end_of = np.array([ending(w) for w in words], np.int64)
    types = np.concatenate([np.arange(frequent), frequent + end_of[frequent:], frequent + np.arange(ENDINGS + 1)]).astype(np.int64)
    classes = exchange(_bigrams(paths, types, frequent + ENDINGS + 1))[types]
    classes = sweep(paths, classes, swept)

    found = cut(further(paths, classes, swept), "classes")
    middle = found.where("code is not null").select("code", "class").toArrow()
    classes = classes.copy()
    classes[middle["code"].to_numpy()] = middle["class"].to_numpy()
    rare = found.where("word is not null").select("word", "n", "class")

    mass = np.bincount(classes[:size], numbers + ROOM, CLASSES) + np.bincount(classes[size:-1], minlength=CLASSES) * ROOM
    for row in rare.groupBy("class").agg(F.sum(F.col("n") + F.lit(ROOM)).alias("mass")).collect():
        mass[row["class"]] += row["mass"]
    mass[0] = ends + ROOM
    table = _bigrams(paths, classes, CLASSES)
    anywhere = (mass + 1) / (mass + 1).sum()
    steps = np.log10((table + STRENGTH * anywhere) / (table.sum(1, keepdims=True) + STRENGTH))
    rooms = np.log10(np.maximum(mass, ROOM))
    return Model(words, numbers, int(total) + ends, int(distinct) + (ends > 0), ends, classes, steps, rooms), rare


def score(docs: DataFrame, model: Model, rare: DataFrame, held_out: Column) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, perplexity.

    Tokens are lower-cased words and one end. base_score is the base-10 logarithm of the
    text's probability under unigram counts plus one, score that under the model.
    Null text is empty: its one token is the end. Repeated rows are scored each."""
    spark = docs.sparkSession
    source = texts(docs, held_out.alias("held_out")).withColumn("row", F.monotonically_increasing_id())
    sent = spark.sparkContext.broadcast(model)
    rest = float(np.log10(model.tokens + model.distinct + 1))

    def run(batches):
        model = sent.value
        codes, size = Codes(model.head), len(model.head)
        counts = np.concatenate([np.log10(model.head_counts + 1.0), np.zeros(ENDINGS)])
        emitted = np.concatenate([np.log10(model.head_counts + ROOM), np.zeros(ENDINGS)]) - model.rooms[model.classes[:-1]]
        emitted[size:] = 0.0
        # Words outside the head stand as class CLASSES + class of the ending until their join.
        classes = model.classes.copy()
        classes[size:-1] += CLASSES
        steps = np.zeros((2 * CLASSES, 2 * CLASSES))
        steps[:CLASSES, :CLASSES] = model.steps
        end, last = model.classes[-1], np.log10(model.ends + 1.0)
        for batch in batches:
            words, starts = split_words(batch.column(1))
            code, length = codes.of(words), np.diff(starts)
            text, step_of = (np.repeat(np.arange(len(length)), length + more) for more in (0, 1))
            # All texts in a row, an end before each and after the last: word i of text k is at 1 + i + k.
            path = np.concatenate([[end], np.insert(classes[code], starts[1:], end)])
            scores = np.bincount(text, emitted[code], len(length)) + np.bincount(step_of, steps[path[:-1], path[1:]], len(length))
            bases = np.bincount(text, counts[code], len(length)) + last
            at, rare = _outside(code, starts, size, words)
            n_known = length - np.diff(rare.offsets.to_numpy()) + (model.ends > 0)
            own = at + text[at] + 1
            places, before, own, after = (pa.array(part.astype(np.int32)) for part in (at - starts[text[at]], path[own - 1], path[own] - CLASSES, path[own + 1]))
            tail = pa.StructArray.from_arrays([places, rare.values, before, own, after], ["at", "word", "before", "own", "after"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(length + 1), pa.array(n_known.astype(np.int64)), pa.array(bases.astype(np.float64)), pa.array(scores.astype(np.float64)), pa.ListArray.from_arrays(rare.offsets, tail)],
                ["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "score", "tail"],
            )

    def completed(batches):
        """Adds what the words outside the head say, in their order."""
        model = sent.value
        for batch in batches:
            tail = batch.column(batch.schema.names.index("met"))
            lengths = pc.fill_null(pc.list_value_length(tail), 0).to_numpy()
            flat = tail.flatten()
            at, before, own, after, n = (flat.field(name).to_numpy(zero_copy_only=False) for name in ("at", "before", "own", "after", "n"))
            text = np.repeat(np.arange(len(lengths)), lengths)
            order = np.lexsort((at, text))
            before, own, after, n = before[order], own[order], after[order], n[order]
            # A neighbour outside the head is the word met just before or after.
            before = np.where(before >= CLASSES, np.concatenate([[0], own[:-1]]) if len(own) else own, before)
            log = np.log10(n + ROOM) - model.rooms[own] + model.steps[before, own]
            inside = after < CLASSES
            log[inside] += model.steps[own[inside], after[inside]]
            more = [np.bincount(text, values, len(lengths)) for values in (log, np.log10(n + 1.0), n > 0)]
            column = dict(zip(batch.schema.names, batch.columns))
            column["score"] = pc.add(column["score"], pa.array(more[0]))
            column["base"] = pc.add(column["base"], pa.array(more[1]))
            column["n_known"] = pc.add(column["n_known"], pa.array(more[2].astype(np.int64)))
            del column["met"]
            yield pa.RecordBatch.from_arrays(list(column.values()), list(column))

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, held_out boolean, row long, n_tokens long, n_known long, base double, score double"
    scored = cut(source.mapInArrow(run, f"{columns}, tail array<struct<at: int, word: binary, before: int, own: int, after: int>>"), "scored")
    tail = scored.select("row", F.explode("tail").alias("x")).select("row", "x.*")
    met = tail.join(rare, "word", "left").select("row", F.struct("at", "before", F.coalesce("class", "own").alias("own"), "after", F.coalesce("n", F.lit(0)).alias("n")).alias("x"))
    joined = scored.drop("tail").join(met.groupBy("row").agg(F.collect_list("x").alias("met")), "row", "left")
    whole = joined.select(*scored.drop("tail").columns, "met").mapInArrow(completed, columns)
    total = F.col("score")
    return whole.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(rest)).alias("base_score"), total.alias("score"), F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )
