import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm.words import invented, lower
from pyspark.sql import functions as F

from rowloom.llm import brown_lm
from rowloom.llm.brown_lm import exchange, learn, score


def base(train, rows):
    counts = Counter()
    for text in train:
        counts.update(lower(text))
        counts["end of text"] += 1
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for doc, text in rows:
        tokens = [*lower(text), "end of text"]
        out.append((doc, len(tokens), sum(counts[t] > 0 for t in tokens), total, sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens)))
    return out


@pytest.mark.parametrize("head", [131_072, 20, 600])
def test_base_against_brute_force(docs, head):
    rows = [(k, " ".join(invented(k, 30 + k, 900))) for k in range(60)] + [(90, None), (91, ""), (92, "Never SEEN before"), (93, "é ü x"), (94, "again"), (94, "again")]
    train = [text for doc, text in rows if doc % 3]
    frame = docs(rows)
    model, rare = learn(frame.where("doc_id % 3 <> 0"), head)
    found = score(frame, model, rare, F.col("doc_id") % 3 == 0).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    for doc, n_tokens, n_known, total, expected in base(train, rows):
        row = by_id[doc]
        assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["held_out"]) == (n_tokens, n_known, total, doc % 3 == 0)
        assert abs(row["base_score"] - expected) < 1e-8 * abs(expected) + 1e-9
        assert row["score"] < 0


def test_probabilities_sum_to_one(docs):
    """Over every head word, the known rare words, one unseen word of every ending, and the end."""
    frame = docs([(k, " ".join(invented(k, 40, 700))) for k in range(30)])
    model, rare = learn(frame, head=100, swept=40, frequent=20)
    chance = np.zeros(brown_lm.CLASSES)
    np.add.at(chance, model.classes[:100], model.head_counts + brown_lm.ROOM)
    np.add.at(chance, model.classes[100:-1], brown_lm.ROOM)
    for row in rare.collect():
        chance[row["class"]] += row["n"] + brown_lm.ROOM
    chance[0] += model.ends + brown_lm.ROOM
    chance /= 10**model.rooms
    assert np.allclose(chance[chance > 0], 1)
    assert np.allclose((10**model.steps).sum(1), 1)
    assert model.classes[-1] == 0 and model.classes[:-1].min() > 0


@pytest.mark.parametrize("head, swept, frequent", [(60, 30, 10), (5, 3, 2), (2000, 2000, 512)])
def test_score_against_brute_force(docs, head, swept, frequent):
    rows = [(k, " ".join(invented(k % 7, 30 + k, 900))) for k in range(40)] + [(90, None), (91, " "), (92, "Never SEEN before at all"), (93, "é never é"), (94, "again"), (94, "again")]
    frame = docs(rows)
    train = [text for doc, text in rows if doc % 3]
    model, rare = learn(frame.where("doc_id % 3 <> 0"), head, swept, frequent)
    counts = Counter(word for text in train for word in lower(text))
    class_of = dict(zip(model.head, model.classes.tolist())) | {bytes(r["word"]): r["class"] for r in rare.collect()}
    assert set(class_of) == set(counts)
    assert sorted(model.head, key=lambda w: (-counts[w], w)) == model.head and len(model.head) == min(head, len(counts))
    assert min(counts[w] for w in model.head) >= max((counts[w] for w in set(counts) - set(model.head)), default=0)

    def chance(text):
        total, before = 0.0, 0
        for word in lower(text):
            own = class_of.get(word, int(model.classes[len(model.head) + brown_lm.ending(word)]))
            total += model.steps[before, own] + math.log10(counts[word] + brown_lm.ROOM) - model.rooms[own]
            before = own
        return total + model.steps[before, 0]

    expected = sorted((doc, chance(text)) for doc, text in rows)
    found = sorted((r["doc_id"], r["score"]) for r in score(frame, model, rare, F.col("doc_id") % 3 == 0).collect())
    assert [d for d, _ in found] == [d for d, _ in expected]
    assert np.allclose([s for _, s in found], [s for _, s in expected])


def test_further_words_go_where_the_likelihood_rises_most(docs):
    """Each word outside the sweeps, against the gain counted word by word."""
    rows = [(k, " ".join(invented(k % 5, 60, 150))) for k in range(25)]
    source = brown_lm.texts(docs(rows))
    counts = Counter(word for _, text in rows for word in lower(text))
    head = sorted(counts, key=lambda w: (-counts[w], w))[:60]
    paths = brown_lm.coded(source, source.sparkSession.sparkContext.broadcast(head))
    draw = np.random.default_rng(1)
    classes = np.append(draw.integers(1, 6, 60 + brown_lm.ENDINGS), 0)
    codes = brown_lm.Codes(head)
    right, left, table = {}, {}, np.zeros((brown_lm.CLASSES, brown_lm.CLASSES))
    for _, text in rows:
        words = lower(text)
        path = [0, *classes[codes.of(words)].tolist(), 0]
        np.add.at(table, (path[:-1], path[1:]), 1)
        for word, a, b in zip(words, path, path[2:]):
            left.setdefault(word, np.zeros(brown_lm.CLASSES))[a] += 1
            right.setdefault(word, np.zeros(brown_lm.CLASSES))[b] += 1
    found = brown_lm.further(paths, classes, 20).collect()
    assert {head[r["code"]] if r["word"] is None else bytes(r["word"]): r["n"] for r in found} == {w: counts[w] for w in set(counts) - set(head[:20])}
    for r in found:
        word = head[r["code"]] if r["word"] is None else bytes(r["word"])
        gain = brown_lm.gains(table, right[word], left[word], 0.0)
        assert gain[r["class"]] >= gain.max() - 1e-6


def test_sweeps_raise_what_classes_tell(docs):
    source = brown_lm.texts(docs(made_language()))
    counts = Counter(word for _, text in made_language() for word in lower(text))
    head = sorted(counts, key=lambda w: (-counts[w], w))[:200]
    paths = brown_lm.coded(source, source.sparkSession.sparkContext.broadcast(head))
    types = np.array([*range(40), *(40 + brown_lm.ending(w) for w in head[40:]), *(40 + np.arange(brown_lm.ENDINGS + 1))])
    begin = exchange(brown_lm._bigrams(paths, types, 40 + brown_lm.ENDINGS + 1))[types]
    end = brown_lm.sweep(paths, begin, 200)
    told = [brown_lm.information(brown_lm._bigrams(paths, of, brown_lm.CLASSES)) for of in (begin, end)]
    assert told[1] > 1.2 * told[0]


def made_language(kinds=4, words=150, texts=400):
    """Words of one kind follow words of the kind before; their letters tell nothing."""
    draw = np.random.default_rng(5)
    spelled = draw.permutation(kinds * words)
    rows = []
    for doc in range(texts):
        at = draw.integers(kinds)
        length = int(draw.integers(20, 60))
        rows.append((doc, " ".join(f"w{spelled[(at + k) % kinds * words + int(words * draw.random() ** 2)]:03d}" for k in range(length))))
    return rows


def test_words_past_the_types_and_the_sweeps_get_their_classes(docs):
    rows = made_language()
    model, rare = learn(docs(rows), head=300, swept=100, frequent=40)
    kind = {}
    draw = np.random.default_rng(5).permutation(600)
    for place, name in enumerate(draw):
        kind[f"w{name:03d}".encode()] = place // 150
    class_of = list(zip(model.head, model.classes.tolist(), model.head_counts.tolist())) + [(bytes(r["word"]), r["class"], r["n"]) for r in rare.collect()]
    assert len(class_of) > 500
    for low, high, least in ((0, 100, 0.95), (100, 300, 0.9), (300, 600, 0.75)):
        weight = Counter()
        for word, of, n in class_of:
            weight[of, kind[word]] += n
        main = {of: max(range(4), key=lambda k: weight[of, k]) for of in range(64)}
        part = class_of[low:high]
        assert sum(n for w, of, n in part if main[of] == kind[w]) >= least * sum(n for _, _, n in part)


def test_better_than_base_on_held_out(spark):
    data = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model, rare = learn(data.where("doc_id % 5 <> 0"))
    total = score(data, model, rare, F.col("doc_id") % 5 == 0).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert total[0] > total[1]


def test_exchange_finds_the_classes_of_a_made_language():
    draw = np.random.default_rng(3)
    kinds = np.arange(40) % 4
    bigrams = np.zeros((41, 41))
    for _ in range(20_000):
        a = draw.integers(40)
        bigrams[a, draw.choice(np.flatnonzero(kinds == (kinds[a] + 1) % 4))] += 1
    found = exchange(bigrams, 5)
    assert found[-1] == 0 and all(len(set(found[:40][kinds == k])) == 1 for k in range(4))


def test_empty(docs):
    model, rare = learn(docs([]))
    assert score(docs([]), model, rare, F.lit(True)).collect() == []
    (row,) = score(docs([(1, "a b")]), model, rare, F.lit(True)).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)


def test_batches_of_words_against_single_words():
    """Words, their codes and their counts, text by text."""
    texts = [b" Two  WORDS\t", None, b"", b"\x0b \x0c", "é É x\x1cy\x85z".encode(), b"\xff\xfeA b\r\nc", b"two \xc3"]
    expected = [(text or b"").lower().split() for text in texts]
    for low in (0, 2):
        words, starts = brown_lm.split_words(pa.array(texts, pa.binary())[low:])
        assert [words[a:b].to_pylist() for a, b in zip(starts, starts[1:])] == expected[low:]
    head = [b"two", b"b"]
    code = brown_lm.Codes(head).of(words)
    assert code.tolist() == [head.index(w) if w in head else 2 + brown_lm.ending(w) for part in expected[2:] for w in part]


def test_word_counts_that_do_not_fit(docs, monkeypatch):
    rows = [(k, " ".join(invented(k, 80, 5000))) for k in range(40)]
    monkeypatch.setattr(brown_lm, "HELD", 50)
    docs([]).sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = {bytes(r["word"]): r["n"] for r in brown_lm.word_counts(brown_lm.texts(docs(rows))).collect()}
    finally:
        docs([]).sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == Counter(word for _, text in rows for word in lower(text))
