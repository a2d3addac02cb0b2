"""Periodic runs in texts: stretches of words that repeat four times or more in a row.

Words are appended one by one to a suffix automaton. Its suffix links form a tree, cut into
paths of states whose strings all ended last at the same word. Appending a word recolours the
path from the new state to the root, as a link-cut tree gives access to a node: piece by piece,
each piece with one end of its last occurrence. If that end lies p words back and the piece
holds a string of p words or more, a square of period p ends here; it is extended both ways.
Periods found so are smallest: a smaller one would have given a later end.

Only stretches that can hold such a run go through the automaton. A run of period q has, but
for its first q words, only three-word sequences that came at most q words before, three times
q of them less two; stretches that are too short for how far back their sequences lie are left
out. This is done over hashes and only ever keeps too much; the automaton compares words.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .frames import texts
from .text import WordHashes, blank_words, window_hashes

#: A run has this many periods and this many words at least.
PERIODS, SHORTEST, GRAM = 4, 6, 3
NEVER = np.iinfo(np.int64).max
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


@dataclass(frozen=True, order=True)
class Run:
    start: int
    period: int
    length: int


def candidates(hashes: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (first word, one past the last) that hold every run of four periods."""
    if len(hashes) < SHORTEST:
        return []
    grams = window_hashes(hashes, GRAM)
    order = np.argsort(grams, kind="stable")
    same = np.flatnonzero(grams[order[1:]] == grams[order[:-1]])
    if len(same) < GRAM:
        return []
    back = np.full(len(grams), NEVER)
    back[order[1:][same]] = order[1:][same] - order[:-1][same]
    while True:
        at = np.flatnonzero(back < NEVER)
        if not len(at):
            return []
        begin = np.concatenate([[0], np.flatnonzero(np.diff(at) > 1) + 1])
        size = np.diff(np.append(begin, len(at)))
        # A run of period q fills 3q - 2 places of a stretch (three, if q is 1).
        reach = np.where(size < SHORTEST - GRAM, 0, (size + GRAM - 1) // (PERIODS - 1))
        far = back[at] > np.repeat(reach, size)
        if not far.any():
            first, last = at[begin], at[begin] + size
            return list(zip(np.maximum(first - reach, 0).tolist(), (last + GRAM - 1).tolist()))
        back[at[far]] = NEVER


class LastEnds:
    """The suffix automaton of the words appended so far, and for each state the last end of
    its strings, one colour for each path of a splay tree."""

    def __init__(self) -> None:
        self.go: list[dict] = [{}]  # by state: word -> state
        self.longest, self.link = [0], [-1]
        # Splay trees over paths, deeper states to the right; `up` of a root is the state that
        # its path hangs from. Colours are kept at the roots.
        self.up, self.left, self.right, self.colour = [-1], [-1], [-1], [-1]
        self.whole = 0

    def _state(self, go: dict, longest: int, link: int) -> int:
        self.go.append(go)
        self.longest.append(longest)
        self.link.append(link)
        self.up.append(link)
        self.left.append(-1)
        self.right.append(-1)
        self.colour.append(-1)
        return len(self.go) - 1

    def append(self, word) -> list[tuple[int, int]]:
        """Add a word; (last end, length of the longest string) of every piece of its path."""
        go, longest, link = self.go, self.longest, self.link
        state, new = self.whole, self._state({}, longest[self.whole] + 1, 0)
        while state >= 0 and word not in go[state]:
            go[state][word] = new
            state = link[state]
        if state >= 0:
            target = go[state][word]
            if longest[state] + 1 != longest[target]:
                target = self._split(state, target, word)
            link[new] = self.up[new] = target
        self.whole = new
        return self._recolour(new, longest[new] - 1)

    def _split(self, state: int, target: int, word) -> int:
        """A state of its own for the shorter strings of `target`: above it on its path."""
        copy = self._state(dict(self.go[target]), self.longest[state] + 1, self.link[target])
        self.link[target] = copy
        self._splay(target)
        self.left[copy] = self.left[target]
        if self.left[copy] >= 0:
            self.up[self.left[copy]] = copy
        self.left[target], self.up[copy] = copy, target
        while state >= 0 and self.go[state].get(word) == target:
            self.go[state][word] = copy
            state = self.link[state]
        return copy

    def _recolour(self, new: int, end: int) -> list[tuple[int, int]]:
        up, right, colour, pieces = self.up, self.right, self.colour, []
        below, state = new, up[new]
        while state >= 0:
            self._splay(state)
            pieces.append((colour[state], self.longest[state]))
            deeper = right[state]
            if deeper >= 0:  # it keeps its colour and hangs from `state`
                colour[deeper] = colour[state]
            right[state], up[below] = below, state
            below, state = state, up[state]
        colour[below] = end
        return pieces

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        first = top = x
        while (parent := up[top]) >= 0 and (left[parent] == top or right[parent] == top):
            top = parent
        if top == first:
            return
        self.colour[x] = self.colour[top]
        while (parent := up[x]) >= 0 and (left[parent] == x or right[parent] == x):
            above = up[parent]
            if above >= 0 and (left[above] == parent or right[above] == parent):
                self._rotate(parent if (left[above] == parent) == (left[parent] == x) else x)
            self._rotate(x)

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        parent = up[x]
        above = up[parent]
        if left[parent] == x:
            moved = left[parent] = right[x]
            right[x] = parent
        else:
            moved = right[parent] = left[x]
            left[x] = parent
        if moved >= 0:
            up[moved] = parent
        if above >= 0:
            if left[above] == parent:
                left[above] = x
            elif right[above] == parent:
                right[above] = x
        up[x], up[parent] = above, x


def same_words(words: list, first: int, second: int, step: int) -> int:
    """For how many words the text reads alike from `first` and `second` (the larger) on,
    going forwards (step 1) or backwards (-1)."""
    size, block = 0, 16
    room = len(words) - second if step > 0 else first + 1
    while size < room:
        block = min(2 * block, room - size)
        a, b = first + step * size, second + step * size
        if step > 0:
            one, two = words[a : a + block], words[b : b + block]
        else:
            one, two = words[a - block + 1 : a + 1][::-1], words[b - block + 1 : b + 1][::-1]
        if one != two:
            return size + next(k for k, (x, y) in enumerate(zip(one, two)) if x != y)
        size += block
    return size


def runs_of(words: list, hashes: np.ndarray | None = None) -> list[Run]:
    """All maximal runs of `words` of four periods and six words at least, by start and period."""
    found: set[Run] = set()
    for first, last in candidates(hashes) if hashes is not None else [(0, len(words))]:
        ends, known = LastEnds(), {}
        for at in range(first, last):
            for end, longest in ends.append(words[at]):
                period = at - first - end
                if longest < period or end < 0 or known.get(period, -1) >= at:
                    continue
                start = at - period - longest + 1
                if start == first:
                    start -= same_words(words, start - 1, start - 1 + period, -1)
                stop = at + 1 + same_words(words, at + 1 - period, at + 1, 1)
                known[period] = stop - 1
                if stop - start >= max(SHORTEST, PERIODS * period):
                    found.add(Run(start, period, stop - start))
    return sorted(found)


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """`words` without what follows the first period of any run."""
    if not runs:
        return words
    gone = np.zeros(len(words), np.bool_)
    for run in runs:
        gone[run.start + run.period : run.start + run.length] = True
    return [words[k] for k in np.flatnonzero(~gone).tolist()]


def echoed(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's planted repetition: of one document in ten (by the crc32 of its id) the
    words from some place on go round and round. Without id, the words as they are."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    circle = words[first : first + period]
    return words[:first] + (circle * ((n - first) // period + 1))[: n - first]


def find_runs(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, runs (array of start, length,
    period; in words from 0, by start, then period) and collapsed, the words left when every
    run keeps its first period only, joined by one blank, as UTF-8 bytes.

    A run is a stretch with smallest period q of at least max(6, 4q) words that no neighbour
    extends. Runs may overlap; a word goes if any run has it after its first period. `change`
    may rewrite the words of a text first. Null and empty texts have no words, no runs and an
    empty rest. Repeated rows give repeated rows, other columns of `docs` are not read, an empty
    table gives no rows. Texts go through whole; what a task holds grows with the longest
    stretch of one text that repeats itself, not with the number of texts.
    """

    def run(batches):
        table = WordHashes()
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = blank_words(text.as_py())
                words = change(doc_id, words) if change else words
                runs = runs_of(words, table.of(words)) if len(words) >= SHORTEST else []
                left = b" ".join(collapsed(words, runs))
                rows.append((doc_id, len(words), [{"start": r.start, "length": r.length, "period": r.period} for r in runs], left))
                held += len(left)
                if held > 4_000_000:
                    yield packed(rows, batch.schema.field(0).type)
                    rows, held = [], 0
            if rows:
                yield packed(rows, batch.schema.field(0).type)

    def packed(rows, id_type):
        ids, counts, runs, left = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(left, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    source = texts(docs)
    added = StructType.fromDDL("n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return source.mapInArrow(run, StructType([source.schema["doc_id"], *added.fields]))
