import collections
import hashlib
import random

import pytest
from llm.words import invented

from rowloom.llm import substring_dedup
from rowloom.llm.substring_dedup import find_repeats, remove_repeats


def brute(rows, size=35):
    count, words = collections.Counter(), []
    for _, text, *_ in rows:
        w = (text or "").encode().split()
        words.append(w)
        count.update(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
    out = []
    for (doc, *_), w in zip(rows, words):
        gone = {k + j for k in range(len(w) - size + 1) if count[tuple(w[k : k + size])] > 1 for j in range(size)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    draw, rows = random.Random(4), []
    passages = [invented(50 + k, length) for k, length in enumerate([34, 35, 36, 60, 200])]
    for number in range(120):
        words = invented(1000 + number, draw.randint(1, 80), 3000)
        for _ in range(draw.choice([0, 1, 2])):
            at = draw.randint(0, len(words))
            words[at:at] = draw.choice(passages)
        rows.append((number, " ".join(words)))
    rows += [rows[3], (900, rows[3][1]), (901, None), (902, ""), (903, " \n "), (904, "x " * 34), (905, "y " * 35), (906, "z " * 36), (None, rows[5][1])]
    return rows + [(907, "word " * 500), (908, " ".join(f"a{k % 7}" for k in range(200)))]


def test_against_brute_force(docs, spark):
    rows = corpus()
    found = find_repeats(docs(rows).repartition(5)).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)


@pytest.mark.parametrize("bits, held", [(26, 50), (4, 3_000_000), (4, 50)])
def test_full_sketches_and_small_batches_lose_nothing(docs, monkeypatch, bits, held):
    rows = corpus()
    monkeypatch.setattr(substring_dedup, "HELD", held)
    texts = docs(rows).repartition(3)
    if bits == 4:  # as if the sketch were full
        monkeypatch.setattr(substring_dedup, "_sketch", lambda source, size: __import__("numpy").full(2 << 26 >> 3, 255, "uint8"))
    assert sorted(map(tuple, find_repeats(texts).collect()), key=str) == brute(rows)


def test_other_sizes(docs):
    rows = [(1, "a b c d e f"), (2, "x b c d y"), (3, "b c")]
    assert sorted(map(tuple, find_repeats(docs(rows), 3).collect())) == brute(rows, 3)


def test_removing(documents):
    passage = " ".join(invented(9, 40))
    rows = [(1, f"first line\nsecond {passage}\nlast  line"), (2, passage), (3, "clean\ttext \n"), (4, None), (5, "")]
    out = remove_repeats(documents(rows))
    assert out.columns == documents(rows).columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()} == {1: ("first line\nsecond\nlast  line", 28), 3: ("clean\ttext \n", 12), 4: (None, 0), 5: ("", 0)}


def test_empty(docs):
    assert find_repeats(docs([])).collect() == []
