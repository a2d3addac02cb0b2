import hashlib

import pytest
from llm.words import invented

from rowloom.llm.decontaminate import find_benchmark, remove_benchmark

KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text):
    return (text or "").encode().translate(KEPT).split()


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(k, " ".join(invented(100 + k, 30))) for k in range(20)] + [
    (20, "short item here"), (21, None), (22, ""), (23, "..."), (2, " ".join(invented(102, 30))), (None, "no id for this one"), (24, "Ünï-cödé, wörds"),
]
TEXTS = [
    (1, " ".join(invented(1, 50) + invented(103, 30) + invented(2, 20))),
    (2, " ".join(invented(1, 50))),
    (3, " ".join(invented(104, 30)[5:14]) + " and so on"),
    (4, " ".join(invented(104, 30)[5:15]).upper()),
    (5, "A SHORT: item, here! and a short item here"),
    (6, None), (7, ""), (8, "\n"), (9, "no id for this one"), (10, "über Ünï cödé wörds"),
    (11, " ".join(invented(110, 30) + invented(110, 30)[1:])), (2, " ".join(invented(1, 50))), (None, " ".join(invented(105, 30))),
]


@pytest.mark.parametrize("block", [500_000, 40])
def test_against_brute_force(docs, block):
    found = find_benchmark(docs(TEXTS), docs(ITEMS, "item_id long, text string"), block=block).drop("items").collect()
    assert sorted(map(tuple, found), key=str) == brute(TEXTS, ITEMS)


def test_removing(documents, docs):
    text = "One two three.\nFour five six"
    rows = [(1, f"before it, {text}! after\nit"), (2, "clean  text\n"), (3, text), (4, None), (5, "")]
    items = docs([(1, text)], "item_id long, text string")
    whole = remove_benchmark(documents(rows), items)
    assert whole.columns == documents(rows).columns
    assert sorted(r["doc_id"] for r in whole.collect()) == [2, 4, 5]
    parts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in remove_benchmark(documents(rows), items, "spans").collect()}
    assert parts == {1: ("before it\nafter\nit", 18), 2: ("clean  text\n", 12), 4: (None, 0), 5: ("", 0)}


def test_empty_tables(docs):
    none = docs([], "item_id long, text string")
    assert find_benchmark(docs([]), none).collect() == []
    assert [tuple(r)[1:4] for r in find_benchmark(docs([(1, "a b")]), none).collect()] == [(2, 0, 0)]


def test_clashing_columns(docs):
    rows = docs([(1, "alpha beta", 5, "x")], "doc_id long, text string, hits long, row string")
    out = remove_benchmark(rows, docs([(1, "gamma", 3)], "item_id string, text string, doc_id long"))
    assert out.columns == ["doc_id", "text", "hits", "row"] and out.count() == 1
