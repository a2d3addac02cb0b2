"""Language identification of whole texts, span by span.

Learning counts byte n-grams (inside words, with word ends) per language over all labelled
texts, in a table of fixed size per language, and the scripts each language is written in.
A word is scored by every language that uses its script. The best path through the words
of a text, where changing language costs `switch`, labels each word; stretches with one
label are the spans of a mixed text. Texts run through the path search side by side.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .frames import prepared

GRAM_BITS, ORDERS, SMOOTHING, SWITCH, HELD = 16, (1, 2, 3, 4), 0.5, 8.0, 200_000
NONE = "und"
#: Scripts and the code points that tell them, as ranges.
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Kana": [(0x3040, 0x30FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
}
#: Letters and marks with one letter at least.
WORD = regex.compile(r"\p{M}*+\p{L}[\p{L}\p{M}]*+")
_FIRST = np.array([low for ranges in SCRIPTS.values() for low, _ in ranges])
_LAST = np.array([high for ranges in SCRIPTS.values() for _, high in ranges])
_OF = np.array([number for number, ranges in enumerate(SCRIPTS.values()) for _ in ranges])
_ORDER = np.argsort(_FIRST)
ANY = len(SCRIPTS)


@lru_cache(maxsize=100_000)
def script(letter: str) -> int:
    """Number of the script of a letter, or ANY."""
    at = int(np.searchsorted(_FIRST[_ORDER], ord(letter), side="right")) - 1
    return int(_OF[_ORDER[at]]) if at >= 0 and ord(letter) <= _LAST[_ORDER[at]] else ANY


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # grams x languages, log probability
    scripts: np.ndarray  # (scripts + 1) x languages, whether a language is written so


def _grams(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, the gram number that begins at each byte of all words in a row (one
    past the last number where it would leave its word); and where each word begins."""
    data = [b" " + word.encode() + b" " for word in words]
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    lengths = np.array([len(x) for x in data])
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(flat))
    numbers, value = [], np.zeros(len(flat), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        value = value * np.uint32(0x01000193)
        value[: len(flat) - order + 1] ^= flat[order - 1 :]
        if order in ORDERS:
            mixed = (value + np.uint32(order)) * np.uint32(0x9E3779B1)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            numbers.append(np.where(left >= order, mixed >> np.uint32(32 - GRAM_BITS), 1 << GRAM_BITS).astype(np.int64))
    return numbers, np.concatenate([[0], np.cumsum(lengths)[:-1]])


def _words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def learn(labelled: DataFrame) -> Model:
    """Count over every row (text, lang) with both. Without any, the model knows no language."""
    prepared(labelled.sparkSession)
    source = labelled.where("text is not null and lang is not null").select("text", "lang")

    def tally(batches):
        counts, scripts, words = {}, Counter(), {}

        def spend():
            for lang, seen in words.items():
                table = counts.setdefault(lang, np.zeros(1 << GRAM_BITS, np.int64))
                names = list(seen)
                for low in range(0, len(names), 20_000):
                    part = names[low : low + 20_000]
                    numbers, starts = _grams(part)
                    weight = np.repeat(np.fromiter((seen[w] for w in part), np.int64, len(part)), np.diff(np.append(starts, len(numbers[0]))))
                    for number in numbers:
                        table += np.bincount(number, weight, (1 << GRAM_BITS) + 1)[:-1].astype(np.int64)
                for word, many in seen.items():
                    scripts[lang, script(word[0])] += many
            words.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(_words(text))
                if sum(map(len, words.values())) > HELD:
                    spend()
        spend()
        for lang, table in counts.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(table[at])], ["lang", "gram", "n"])
        if scripts:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in scripts], pa.string()), pa.array([-1 - k[1] for k in scripts], pa.int32()), pa.array(list(scripts.values()), pa.int64())], ["lang", "gram", "n"])

    told = source.mapInArrow(tally, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(told["lang"].to_pylist()))
    if not languages:
        return Model([], np.zeros((1 << GRAM_BITS, 0), np.float32), np.zeros((ANY + 1, 0), np.bool_))
    column = np.searchsorted(np.array(languages), told["lang"].to_numpy(zero_copy_only=False).astype(str))
    gram, n = told["gram"].to_numpy(), told["n"].to_numpy()
    counts, scripts = np.zeros((1 << GRAM_BITS, len(languages))), np.zeros((ANY + 1, len(languages)))
    counts[gram[gram >= 0], column[gram >= 0]] = n[gram >= 0]
    scripts[-1 - gram[gram < 0], column[gram < 0]] = n[gram < 0]
    weights = np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * (1 << GRAM_BITS)))
    used = scripts > 0.001 * scripts.sum(0)
    used[ANY] = True
    return Model(languages, weights.astype(np.float32), used)


class Scores(dict):
    """Word -> number of its row of scores, for at most `HELD` words at a time."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.new, self.table = model, [], np.zeros((0, len(model.languages)), np.float32)
        self.weights = np.concatenate([model.weights, np.zeros((1, len(model.languages)), np.float32)])

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        number = self[word] = len(self)
        return number

    def renew(self) -> None:
        if len(self) > HELD:
            self.clear()
            self.table = self.table[:0]

    def rows(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def _scored(self, words: list[str]) -> np.ndarray:
        numbers, starts = _grams(words)
        total = self.weights[numbers[0]]
        for number in numbers[1:]:
            total += self.weights[number]
        # Grams of several orders overlap, so their sum is damped by the number of orders.
        score = np.add.reduceat(total, starts, axis=0) / len(ORDERS)
        score -= score.max(1, keepdims=True)
        allowed = self.model.scripts[[script(w[0]) for w in words]]
        allowed |= ~allowed.any(1, keepdims=True)
        return np.where(allowed, np.maximum(score, -12.0), -40.0).astype(np.float32)

    def settle(self) -> np.ndarray:
        if self.new:
            parts = [self._scored(self.new[low : low + 20_000]) for low in range(0, len(self.new), 20_000)]
            self.table = np.concatenate([self.table, *parts])
            self.new = []
        return self.table


def one_language(scores: np.ndarray, switch: float) -> int | None:
    """The language of all words, if no path that changes language can be better, else None.

    Of the paths without change, the best is taken. If no stretch of words gains half of
    `switch` or more by another language, then k stretches gain less than k / 2 times `switch`
    and cost k times that, or k - 1 times if the best language is given up for good."""
    scores = scores.astype(np.float64)
    best = int(scores.sum(0).argmax())
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    lowest = np.minimum.accumulate(np.vstack([np.zeros((1, scores.shape[1])), gain[:-1]]), axis=0)
    return best if (gain - lowest).max() < switch / 2 - 1e-3 else None


def paths_of(rows: list[np.ndarray], table: np.ndarray, switch: float) -> list[np.ndarray]:
    """The best language of each word of each text; only texts that may change language are
    searched."""
    out = [np.empty(0, np.int64)] * len(rows)
    searched = []
    for k, row in enumerate(rows):
        if len(row):
            found = one_language(table[row], switch)
            if found is None:
                searched.append(k)
            else:
                out[k] = np.full(len(row), found, np.int64)
    for k, path in zip(searched, best_paths([rows[k] for k in searched], table, switch)):
        out[k] = path
    return out


def best_paths(rows: list[np.ndarray], table: np.ndarray, switch: float) -> list[np.ndarray]:
    """The best language of each word, for many texts at once: step t handles word t of
    every text that has one, texts in order of length."""
    order = sorted(range(len(rows)), key=lambda k: -len(rows[k]))
    lengths = np.array([len(rows[k]) for k in order])
    if not len(lengths) or not lengths[0]:
        return [np.empty(0, np.int64) for _ in rows]
    alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    offset = np.concatenate([[0], np.cumsum(alive)])
    by_step = np.empty(offset[-1], np.int64)
    for place, k in enumerate(order):
        by_step[offset[: lengths[place]] + place] = rows[k]
    languages = table.shape[1]
    came = np.empty((offset[-1], languages), np.bool_)
    top = np.empty(offset[-1], np.int16)
    total = np.zeros((len(order), languages), np.float32)
    for t in range(lengths[0]):
        n, part = alive[t], slice(offset[t], offset[t + 1])
        now = total[:n]
        best = now.argmax(1)
        change = now[np.arange(n), best][:, None] - switch
        came[part] = change > now
        top[part] = best
        np.maximum(now, change, out=now)
        now += table[by_step[part]]
        now -= now.max(1, keepdims=True)
    labels = np.empty(offset[-1], np.int16)
    state = np.zeros(len(order), np.int64)
    for t in range(lengths[0] - 1, -1, -1):
        n, part = alive[t], slice(offset[t], offset[t + 1])
        ending = np.flatnonzero(lengths[:n] == t + 1)
        state[ending] = total[ending].argmax(1)
        here = state[:n]
        labels[part] = here
        state[:n] = np.where(came[part][np.arange(n), here], top[part], here)
    out: list = [None] * len(rows)
    for place, k in enumerate(order):
        out[k] = labels[offset[: lengths[place]] + place]
    return out


def label(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, lang_pred, score, n_letter_words,
    spans (array of lang, first word, number of words).

    lang_pred is the language of most words, of equals the first by name; score the share
    of words it has, from 0 to 1. Null text, text without letters, and any text under a
    model that knows no language get `und`, 0 and no spans."""
    return _labelled(docs, docs.select(F.struct("doc_id").alias("row"), "text"), model, switch).select("row.doc_id", "lang_pred", "score", "n_letter_words", "spans")


def keep_known(docs: DataFrame, model: Model, least: float = 0.5, switch: float = SWITCH) -> DataFrame:
    """`docs` with all its columns, without the rows labelled `und` and those in which no
    language has a share of `least`. Under a model that knows no language nothing stays."""
    labelled = _labelled(docs, docs.select(F.struct("*").alias("row"), "text"), model, switch)
    return labelled.where((F.col("lang_pred") != NONE) & (F.col("score") >= least)).select("row.*")


def _labelled(docs: DataFrame, source: DataFrame, model: Model, switch: float) -> DataFrame:
    sent = prepared(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        scores = Scores(model)
        for batch in batches:
            for part in _parts(batch):
                texts = part.column(1).to_pylist()
                scores.renew()
                rows = [scores.rows(_words(text)) if model.languages else np.empty(0, np.int64) for text in texts]
                paths = paths_of(rows, scores.settle(), switch)
                names, shares, counts, spans = [], [], [], []
                for path in paths:
                    counts.append(len(path))
                    if not len(path):
                        names.append(NONE)
                        shares.append(0.0)
                        spans.append([])
                        continue
                    votes = np.bincount(path, minlength=len(model.languages))
                    names.append(model.languages[int(votes.argmax())])
                    shares.append(float(votes.max() / len(path)))
                    begin = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
                    size = np.diff(np.append(begin, len(path)))
                    spans.append([{"lang": model.languages[path[b]], "first": b, "words": s} for b, s in zip(begin.tolist(), size.tolist())])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())])))],
                    ["row", "lang_pred", "score", "n_letter_words", "spans"],
                )

    added = "lang_pred string, score double, n_letter_words long, spans array<struct<lang:string,first:int,words:int>>"
    schema = StructType([source.schema["row"], *StructType.fromDDL(added).fields])
    return source.mapInArrow(run, schema)


def _parts(batch, limit: int = 4_000_000):
    """Slices of a batch with a bounded number of characters, one text at least."""
    first, size = 0, 0
    for k, text in enumerate(batch.column(1)):
        length = len(text.as_buffer()) if text.is_valid else 0
        if k > first and size + length > limit:
            yield batch.slice(first, k - first)
            first, size = k, 0
        size += length
    if first < batch.num_rows:
        yield batch.slice(first)
