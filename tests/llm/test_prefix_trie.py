import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from rowloom.llm import prefix_trie as module
from rowloom.llm.prefix_trie import NODE, end_digests, placed, prefix_trie, with_shared_heads

SCHEMA = "conv_id long, turn long, role string, text string"


def by_hand(rows):
    """All nodes, from lists of turns."""
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in turns.items()}
    rebuilt = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + x[h:]
    members = defaultdict(list)
    for c, x in rebuilt.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    out = set()
    for node, ids in members.items():
        below = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode().split()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(c for c in ids if len(rebuilt[c]) == len(node)))
        out.add((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children[node]), sum(not children[n] for n in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def result(frame):
    trie = prefix_trie(*with_shared_heads(placed(frame)))
    nodes = trie.nodes.join(end_digests(trie.ends), list(NODE), "left").collect()
    empty = hashlib.sha256(b"").hexdigest()
    got = [(r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"] or empty) for r in nodes]
    assert len(got) == len(set(got))
    return set(got)


def made(seed, count=90):
    """Conversations with shared beginnings, copies, gaps, nulls, ties and repeated rows."""
    draw, rows = random.Random(seed), []
    for _ in range(count):
        conv_id = draw.choice([None, *range(0, 65)]) if draw.random() < 0.2 else draw.randrange(65)
        for place in range(draw.randint(1, 6)):
            turn = draw.choice([None, place, place, place])
            rows.append((conv_id, turn, draw.choice(["user", "assistant", None]), draw.choice(["yes", "no  way", "", None, "so be it\n"])))
    return rows + rows[:3]


@pytest.mark.parametrize("seed", range(2))
def test_against_lists(docs, seed):
    rows = made(seed)
    assert result(docs(rows, SCHEMA)) == by_hand(rows)


def test_small_blocks_chunks_and_a_long_conversation(docs, monkeypatch):
    """One conversation holds a third of all rows, and totals cross many blocks."""
    monkeypatch.setattr(module, "BLOCK", 7)
    monkeypatch.setattr(module, "CHUNK", 4)
    rows = made(5) + [(40, k, "user", f"word {k % 5}") for k in range(150)] + [(c, 0, "user", "copy") for c in range(1000, 1030)]
    assert result(docs(rows, SCHEMA).repartition(7)) == by_hand(rows)


def test_no_rows_and_extra_columns(docs, spark):
    assert result(docs([], SCHEMA)) == set()
    assert result(docs([(None, 1, "user", "x")], SCHEMA)) == set()
    rows = [(20, 0, "user", "a b"), (21, 0, "user", "a b"), (21, 1, "assistant", "c")]
    wide = docs([(*r, 7, "z", 1) for r in rows], SCHEMA + ", depth int, key string, words int")
    assert result(wide) == by_hand(rows)


def test_very_long_text(docs):
    long = "word " * 300_000
    rows = [(c, 0, "user", long) for c in (0, 1, 2)]
    assert result(docs(rows, SCHEMA)) == by_hand(rows)
