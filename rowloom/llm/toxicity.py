"""Toxic passages by maximum-scoring segments.

Every word gets its log-odds of standing in toxic rather than other texts, under a Dirichlet
prior that draws rare words towards 0. Over the words of a text these are the scores of a
walk that drifts down in harmless text, and one pass in linear time finds every maximal
segment (Ruzzo and Tompa). How high the best segment of harmless text of a length reaches
follows an extreme-value law; one law is fitted for each class, and a document's score is
the posterior of the toxic one. Laws and drift are fitted on texts scored without their own
part in the counts, as texts are that were not learned from.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import configure
from .frames import cut
from .text import ALNUM_OR_BLANK

PRIOR, MOST_TEXTS, DRIFT, HELD = 50.0, 10_000, -0.1, 200_000


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    odds: np.ndarray
    drift: float  # added to every word
    share: float  # of toxic texts among the labelled
    rise_harmless: float  # share of harmless texts in which any word scores above 0
    rise_toxic: float
    laws: list[tuple[float, float]]  # location and scale of the harmless and the toxic texts


class Scores(dict):
    """Word -> log-odds, 0 for words that were not seen; remembered for at most `limit` words."""

    def __init__(self, words: np.ndarray, odds: np.ndarray, limit: int = 250_000):
        super().__init__()
        self.words, self.odds, self.limit = words, odds, limit

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.limit:
            self.clear()
        key = _hash(word)
        at = int(self.words.searchsorted(key))
        value = self[word] = float(self.odds[at]) if at < len(self.words) and self.words[at] == key else 0.0
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.float64, len(words))


def _hash(word: bytes) -> np.int64:
    return np.uint64(xxhash.xxh3_64_intdigest(word)).view(np.int64)


def _words(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM_OR_BLANK).split() if text else []


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score), after Ruzzo and Tompa.

    Each candidate remembers the total before it and after it; a new one joins the nearest
    earlier candidate that starts lower, if its own end is higher, and is tried again.
    Neighbouring scores above 0 always join, so runs of them are the first candidates."""
    found: list[list[float]] = []  # first, end, total before, total after
    totals = np.concatenate([[0.0], np.cumsum(scores)])
    turns = np.diff((scores > 0).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(turns > 0), np.flatnonzero(turns < 0)
    for new in map(list, zip(starts.tolist(), ends.tolist(), totals[starts].tolist(), totals[ends].tolist())):
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = _jump(found, j)
            if j < 0 or found[j][3] >= new[3]:
                new.append(j)
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(int(f[0]), int(f[1]), f[3] - f[2]) for f in found]


def _jump(found: list, j: int) -> int:
    """The candidate that j met when it was placed: between them none starts lower than j."""
    return int(found[j][4])


def bounded(labels: DataFrame, most: int = MOST_TEXTS) -> DataFrame:
    """At most `most` rows of `labels` (doc_id, toxic) of each class, by a hash of the id.
    What is left is small enough, at every size of input, to be sent to all tasks."""
    known = labels.where("toxic is not null and doc_id is not null").select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    parts = [known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for toxic in (0, 1)]
    return parts[0].union(parts[1])


def learn(docs: DataFrame, labels: DataFrame, most_texts: int = MOST_TEXTS, prior: float = PRIOR) -> Model:
    """Learn from the texts of `docs` (doc_id, text) that `labels` (doc_id, toxic) names.

    The share of toxic texts is counted over all labels. Words are counted over at most
    `most_texts` texts of each class, equal texts once, a word once per text. All words of
    these texts are kept. To a word's counts come one text and 2 * `prior` times its share
    of all words, dealt to the classes as all words are, so that without a difference its
    odds are 0.
    Without a toxic or without a harmless text every text is scored with the share alone."""
    spark = configure(docs.sparkSession)
    by_class = dict(labels.where("toxic is not null").groupBy((F.col("toxic") > 0).cast("int")).count().collect())
    share = (by_class.get(1, 0) + 0.5) / (sum(by_class.values()) + 1)
    chosen = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where("text is not null").join(F.broadcast(bounded(labels, most_texts)), "doc_id")
    source = cut(chosen.groupBy("text").agg(F.max("toxic").alias("toxic")), "labelled")

    def tally(batches):
        words = (Counter(), Counter())

        def told():
            names = list(words[0].keys() | words[1].keys())
            for low in range(0, len(names), 50_000):
                part = names[low : low + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([_hash(w) for w in part], pa.int64()), *[pa.array([seen[w] for w in part], pa.int64()) for seen in words]], ["word", "harmless", "toxic"])
            for seen in words:
                seen.clear()

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                words[toxic].update(set(_words(text.as_py())))
                if len(words[0]) + len(words[1]) > HELD:
                    yield from told()
        yield from told()

    counts = source.mapInArrow(tally, "word long, harmless long, toxic long").groupBy("word").agg(F.sum("harmless").alias("h"), F.sum("toxic").alias("t"))
    found = counts.orderBy("word").toArrow()
    words, h, t = (found[c].to_numpy().astype(kind) for c, kind in (("word", np.int64), ("h", np.float64), ("t", np.float64)))
    if not h.sum() or not t.sum():
        return Model(words[:0], h[:0], DRIFT, share, 1.0, 1.0, [])
    part = t.sum() / (t.sum() + h.sum())
    mass = 1 + 2 * prior * (h + t) / (h + t).sum()

    def odds(h: np.ndarray, t: np.ndarray) -> np.ndarray:
        return np.log((t + part * mass) / (h + (1 - part) * mass)) - np.log(part / (1 - part))

    model = Model(words, odds(h, t), DRIFT, share, 1.0, 1.0, [])
    #: The odds that harmless and toxic texts meet if they are not counted themselves.
    others = spark.sparkContext.broadcast((words, odds(np.maximum(h - 1, 0), t), odds(h, np.maximum(t - 1, 0))))

    def harmless_mean(batches):
        words, harmless, _ = others.value
        scores, total, n = Scores(words, harmless), 0.0, 0
        for batch in batches:
            for text in batch.column(0):
                found = scores.of(_words(text.as_py()))
                total, n = total + float(found.sum()), n + len(found)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.float64()), pa.array([n], pa.int64())], ["total", "n"])

    total, n = source.where("toxic = 0").select("text").mapInArrow(harmless_mean, "total double, n long").agg(F.sum("total"), F.sum("n")).first()
    model.drift = drift = DRIFT - max(total / n, 0.0)

    def reach(batches):
        words, *odds = others.value
        scores = [Scores(words, x) for x in odds]
        for batch in batches:
            values = [_best(scores[toxic], drift, _words(text.as_py()))[0] for text, toxic in zip(batch.column(0), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(values, pa.float64())], ["toxic", "height"])

    reached = source.mapInArrow(reach, "toxic int, height double").groupBy("toxic").agg(F.count("*"), F.count("height"), F.expr("percentile(height, array(0.1, 0.5, 0.9))"))
    fitted = {row[0]: row[1:] for row in reached.collect()}
    # Shares are drawn to the common one, of more texts in the larger class, so that where all texts rise, or none, nothing is told.
    least, all_texts, all_risen = min(row[0] for row in fitted.values()), sum(row[0] for row in fitted.values()), sum(row[1] for row in fitted.values())
    usual_rise, rises = (all_risen + 0.5) / (all_texts + 1), []
    for toxic, usual in ((0, (-4.0, 1.0)), (1, (0.0, 1.0))):
        texts, risen, at = fitted[toxic]
        rises.append((risen + usual_rise * texts / least) / (texts + texts / least))
        # Each law is fitted on the side that faces the other: medians and outer tenths.
        if risen >= 10:
            scale = (at[1] - at[0]) / (_reduced(0.5) - _reduced(0.1)) if toxic else (at[2] - at[1]) / (_reduced(0.9) - _reduced(0.5))
            scale = max(scale, 0.25)
            usual = (at[1] - scale * _reduced(0.5), scale)
        model.laws.append(usual)
    model.rise_harmless, model.rise_toxic = rises
    return model


def _reduced(share: float) -> float:
    """Below this many scales over its location lies `share` of an extreme-value law."""
    return -math.log(-math.log(share))


def _best(odds: Scores, drift: float, words: list[bytes]) -> tuple[float | None, list[tuple[int, int, float]]]:
    """Height of the best segment, less the logarithm of the number of words, by which the
    best of many chances rises; None where no word scores above 0. And all segments."""
    scores = odds.of(words) + drift
    if not (scores > 0).any():
        return None, []
    found = segments(scores)
    return max(s for _, _, s in found) - math.log(len(words) + 1), found


def _posterior(model: Model, height: float | None) -> float:
    """Prior odds, times how much likelier a toxic text is to rise at all, times the ratio
    of the two laws at its height. Beyond a law's location its own class only gets surer."""
    odds = math.log(model.share) - math.log(1 - model.share)
    if model.laws and height is None:
        odds += math.log(1 - model.rise_toxic) - math.log(1 - model.rise_harmless)
    elif model.laws:
        def log_density(law, up: bool):
            z = (height - law[0]) / law[1]
            z = min(z, 0.0) if up else max(z, 0.0)
            return -z - math.exp(min(-z, 700.0)) - math.log(law[1])

        odds += math.log(model.rise_toxic) - math.log(model.rise_harmless) + log_density(model.laws[1], True) - log_density(model.laws[0], False)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def score(docs: DataFrame, model: Model, significant: float = 0.01) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, score (0 to 1), predicted (1 from
    0.5 on), n_words, passages (array of first word, words, height, p_value).

    Passages are the maximal segments whose height harmless text of that length reaches
    with a probability of at most `significant`. Null and empty texts have no words and get
    the score of a text in which nothing rises."""
    sent = configure(docs.sparkSession).sparkContext.broadcast(model)
    # A little below the height of `significant`, so as to leave most segments out early.
    least = _reduced(1 - significant) - 1e-6 if 0 < significant < 1 else -math.inf

    def run(batches):
        model = sent.value
        odds = Scores(model.words, model.odds)
        for batch in batches:
            scores, counts, passages = [], [], []
            for text in batch.column(1):
                words = _words(text.as_py())
                height, found = _best(odds, model.drift, words)
                scores.append(_posterior(model, height))
                counts.append(len(words))
                kept = []
                for first, end, top in found if model.laws else ():
                    z = (top - math.log(len(words) + 1) - model.laws[0][0]) / model.laws[0][1]
                    if z < least:
                        continue
                    chance = -math.expm1(-math.exp(min(-z, 700.0)))
                    if chance <= significant:
                        kept.append({"first": first, "words": end - first, "height": top, "p_value": chance})
                passages.append(kept)
            kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("height", pa.float64()), ("p_value", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(counts, pa.int64()), pa.array(passages, kind)],
                ["doc_id", "score", "predicted", "n_words", "passages"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, score double, predicted int, n_words long, passages array<struct<first:int,words:int,height:double,p_value:double>>"
    )
