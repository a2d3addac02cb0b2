import random

import pytest
from llm.words import invented, lower

from rowloom.llm import ngram_join
from rowloom.llm.frames import components
from rowloom.llm.ngram_join import join_ngrams


def brute(rows, n, percent):
    sets = []
    for _, text in rows:
        words = lower(text)
        size = min(n, len(words))
        sets.append({tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if size else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(sets[k]), least[root(k)], links[k]) for k, (i, _) in enumerate(rows))


def corpus(seed=3):
    draw, rows = random.Random(seed), []
    bases = [invented(s, draw.choice([5, 40, 120, 300])) for s in range(12)]
    for number in range(150):
        words = list(draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 6])):
            words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
        rows.append((number * 7 % 151, " ".join(words).capitalize()))
    return rows + [(500, None), (501, ""), (502, " \n\t"), (503, "one two"), (504, "One  TWO"), (505, "one"), (506, "Ünï cödé wörds 試験"), (507, "Ünï cödé wörds 試験")]


@pytest.mark.parametrize("n, percent, hot", [(3, 90, 128), (5, 80, 128), (3, 90, 3), (5, 80, 2)])
def test_against_all_pairs(docs, n, percent, hot):
    rows = corpus()
    found = join_ngrams(docs(rows), n, percent, hot).collect()
    assert sorted(map(tuple, found)) == brute(rows, n, percent)


def test_blocks_of_a_family(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 8)
    rows = corpus(5)
    assert sorted(map(tuple, join_ngrams(docs(rows), 3, 90, 2).collect())) == brute(rows, 3, 90)


@pytest.mark.parametrize("sizes", [(5, 6), (8, 10), (94, 112)])
@pytest.mark.parametrize("percent", [50, 80])
def test_family_of_unlike_lengths(docs, sizes, percent):
    """The shorter texts are beginnings of the longer ones: similar at 80 %, all in one family."""
    rows = []
    for number in range(6):
        words = [f"w{number}x{k}" for k in range(max(sizes) + 4)]
        rows += [(10 * number + k, " ".join(words[: size + 4])) for k, size in enumerate(sizes)]
    assert sorted(map(tuple, join_ngrams(docs(rows), 5, percent, 1).collect())) == brute(rows, 5, percent)


def test_nulls_repeats_and_clashing_columns(docs):
    text = "a b c d e f g h i j k l"
    rows = [(1, text, 9, "x"), (1, text, 9, "x"), (2, text, None, None), (None, text, 1, "y"), (None, None, 1, "y")]
    found = join_ngrams(docs(rows, "doc_id long, text string, rep long, token string")).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"])
    assert sorted(map(tuple, found), key=str) == sorted([(1, 10, 1, 2), (1, 10, 1, 2), (2, 10, 1, 2), (None, 10, None, 0), (None, 0, None, 0)], key=str), key


def test_empty(docs):
    assert join_ngrams(docs([])).collect() == []


def test_very_long_text(docs):
    words = invented(1, 60_000, 5000)
    other = list(words)
    other[100] = "changed"
    found = {r["doc_id"]: r["component_id"] for r in join_ngrams(docs([(7, " ".join(words)), (3, " ".join(other)), (9, "short text of five words")])).collect()}
    assert found == {7: 3, 3: 3, 9: 9}


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (103, 101), (7, 7)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 103: 100}
