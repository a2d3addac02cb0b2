import hashlib
import random
import zlib

import pytest

from rowloom.llm.queries import QUERIES
from rowloom.llm.runs import Run, collapsed, echoed, find_runs, runs_of
from rowloom.llm.text import WordHashes

SF = "/root/testdata/sf0.001"


def by_hand(words):
    """Every run, by comparing all words at every distance."""
    found = []
    for period in range(1, len(words) // 4 + 1):
        at = 0
        while at + period < len(words):
            end = at
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            start, length = at, end + period - at
            enough = end > at and length >= max(6, 4 * period)
            if enough and all(any(words[k] != words[k + p] for k in range(start, start + length - p)) for p in range(1, period)):
                found.append(Run(start, period, length))
            at = end + 1
    return sorted(found)


def made(draw):
    letters = draw.choice([1, 2, 2, 3, 5])
    words = [bytes([97 + draw.randrange(letters)]) for _ in range(draw.randint(0, 60))]
    for _ in range(draw.randint(0, 3)):
        circle = [bytes([97 + draw.randrange(4)]) for _ in range(draw.randint(1, 7))]
        at = draw.randint(0, len(words))
        words[at:at] = (circle * 9)[: draw.randint(1, 9 * len(circle))]
    return words


@pytest.mark.parametrize("seed", range(8))
def test_runs_against_all_distances(seed):
    draw, table = random.Random(seed), WordHashes()
    for _ in range(300):
        words = made(draw)
        expected = by_hand(words)
        assert runs_of(words) == expected  # every word through the automaton
        assert runs_of(words, table.of(words)) == expected  # candidates only


def test_long_runs_and_long_texts():
    table = WordHashes()
    for period, count in ((1, 200_000), (1_000, 60_000), (14_999, 60_000)):
        words = [b"%d" % (k % period) for k in range(count)]
        text = [b"before", *words, b"after"]
        assert runs_of(text, table.of(text)) == [Run(1, period, count)]
        assert collapsed(text, runs_of(text, table.of(text))) == [b"before", *words[:period], b"after"]


def test_overlapping_runs_and_words_with_equal_beginnings():
    words = b"x a a a a a a b a a a a a a b a a a a a a b a a a a a a b y".split()
    assert runs_of(words) == by_hand(words) == sorted([Run(1, 1, 6), Run(8, 1, 6), Run(15, 1, 6), Run(22, 1, 6), Run(1, 7, 28)])


def test_rows(docs):
    text = "go " + "round and " * 5 + "stop"
    rows = docs([(1, None, 0), (2, "", 0), (3, " \n\t", 0), (4, text, 0), (4, text, 0), (None, text, 0), (5, "a a a a a", 0), (6, "é " * 6, 1)], "doc_id long, text string, runs int")
    found = sorted(((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], bytes(r["collapsed"]).decode()) for r in find_runs(rows).collect()))
    once = [(1, 10, 2)], "go round and stop"
    assert found == [(0, 12, *once), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 12, *once), (4, 12, *once), (5, 5, [], "a a a a a"), (6, 6, [(0, 6, 1)], "é")]
    assert find_runs(docs([])).collect() == []


def test_query_against_all_distances(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen = 0
    for row in QUERIES["op11_periodic_runs"](spark, SF).collect():
        words = (texts[row["doc_id"]] or "").encode().split()
        if len(words) > 800:
            continue
        h = zlib.crc32(str(row["doc_id"]).encode())
        if h % 10 == 0 and words:
            first = h // 10 % len(words)
            period = 1 + (len(words) - first) // (3 + h // 10 % 8)
            words = [words[k] if k < first else words[first + (k - first) % period] for k in range(len(words))]
        assert echoed(row["doc_id"], (texts[row["doc_id"]] or "").encode().split()) == words
        runs = by_hand(words)
        kept = [w for k, w in enumerate(words) if not any(r.start + r.period <= k < r.start + r.length for r in runs)]
        top = min(runs, key=lambda r: (-r.length, r.start, r.period), default=None)
        expected = (top.start, top.length, top.period, 1000 * top.length // top.period) if top else (None,) * 4
        assert (row["n_runs"], *(row[n] for n in ("start", "length", "period", "exponent_milli"))) == (len(runs), *expected)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{r.start},{r.length},{r.period}\n" for r in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(b" ".join(kept)).hexdigest()
        seen += len(runs)
    assert seen > 5
