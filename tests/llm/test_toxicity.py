import itertools

import numpy as np
from llm.words import invented

from rowloom.llm.toxicity import bounded, learn, score, segments


def corpus():
    rows, labels = [], []
    for k in range(240):
        words = invented(k, 30 + k % 90, 3000)
        toxic = k % 4 == 0
        if toxic:
            words[5:5] = ["scum", "idiot", "Loser"][: 1 + k % 3]
        rows.append((k, " ".join(words)))
        if k % 5:
            labels.append((k, int(toxic)))
    return rows, labels


def test_finds_unlabelled_toxic_texts(docs):
    rows, labels = corpus()
    frame = docs(rows + [(900, None), (901, ""), (902, "idiot"), (902, "idiot"), (None, "calm words")])
    out = score(frame, learn(frame, docs(labels + [(1, None), (None, 1), (5000, 0)], "doc_id long, toxic int"))).collect()
    found = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows) + 5
    held = [k for k in range(240) if not k % 5]
    assert sum(found[k]["predicted"] == (k % 4 == 0) for k in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert found[900]["predicted"] == found[901]["predicted"] == 0 and found[900]["score"] == found[901]["score"]
    assert found[902]["passages"][0]["first"] == 0


def test_words_of_few_toxic_texts_count(docs):
    """Each toxic word is in two of a hundred toxic texts, and none is sure alone."""
    rows, labels = [], []
    for k in range(400):
        words = invented(k, 60, 2000)
        if k % 2:
            words[9:9] = [f"slur{(k // 2 + 7 * j) % 100}" for j in range(8)]
        rows.append((k, " ".join(words)))
        if k < 200:
            labels.append((k, k % 2))
    frame = docs(rows)
    model = learn(frame, docs(labels, "doc_id long, toxic int"))
    assert (model.odds < 0).any() and (model.odds > 0).any() and model.drift < 0
    held = score(frame, model).where("doc_id >= 200").collect()
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in held) >= 0.9 * len(held)


def test_segments_are_the_maximal_ones():
    """Against the definition: the best segment, then the same left and right of it."""

    def brute(x, low, high):
        every = [(sum(x[a:b]), -(b - a), a, b) for a in range(low, high) for b in range(a + 1, high + 1)]
        best = max(every, default=(0,))
        if best[0] <= 0:
            return []
        _, _, a, b = best
        return [*brute(x, low, a), (a, b, best[0]), *brute(x, b, high)]

    draw = np.random.default_rng(5)
    for length in range(0, 14):
        for _ in range(40):
            x = (draw.integers(-50, 51, length) + draw.random(length) * 1e-3).tolist()
            assert [(a, b) for a, b, _ in segments(np.array(x))] == [(a, b) for a, b, _ in brute(x, 0, length)]


def test_one_class_or_nothing(docs):
    frame = docs([(1, "some words"), (2, "more")])
    for labels in ([], [(1, 0), (2, 0)], [(1, 1)]):
        out = score(frame, learn(frame, docs(labels, "doc_id long, toxic int"))).collect()
        assert len(out) == 2 and len({r["score"] for r in out}) == 1
    assert score(docs([]), learn(docs([]), docs([], "doc_id long, toxic int"))).collect() == []


def test_bound_on_labels(docs):
    chosen = bounded(docs([(k, k % 2) for k in range(50)], "doc_id long, toxic int"), 7).collect()
    assert [sum(r["toxic"] == c for r in chosen) for c in (0, 1)] == [7, 7]
    assert list(itertools.chain.from_iterable([segments(np.zeros(0))])) == []
