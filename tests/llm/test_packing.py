import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rowloom.llm.packing import WordIds, pack, pieces, sequences, sum_of_squares

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH) as file:
        return file.read()


def whole(text, end=1):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, end]


def test_words_apart_give_the_ids_of_the_text(vocabulary):
    table, draw, tokenizer = WordIds(vocabulary), random.Random(1), Tokenizer.from_file(PATH)
    signs = [*"aAbJ̌×÷;:*#%Σςİıßé́̀ \t\n\r\x0b\x0c\x1c\x85  　'sS12漢字가😀.,-!", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|startof", "text|>", "'ll", "ж", "ñ.", "ͅ"]
    for _ in range(3000):
        text = "".join(draw.choice(signs) for _ in range(draw.randint(0, 30)))
        words = table.words(text.encode())
        table.learn(set(words))
        assert np.frombuffer(b"".join(table[w] for w in words), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def greedy(lengths, capacity):
    """The rule, with all open sequences looked at for every piece."""
    room = []
    for length in lengths:
        def squares(place):
            left = [r - length if k == place else r for k, r in enumerate(room)]
            counts = np.bincount([x for x in left if 0 < x], minlength=1)
            return int((counts**2).sum())
        fits = [k for k, r in enumerate(room) if r >= length]
        if fits:
            best = min(fits, key=lambda k: (squares(k), room[k]))
            room[best] -= length
        else:
            room.append(capacity - length)
    return sorted(room)


@pytest.mark.parametrize("seed", range(6))
def test_places_by_sums_of_squares(seed):
    draw = random.Random(seed)
    lengths = [draw.randint(1, 20) for _ in range(120)]
    sequence, offset, room = sum_of_squares(np.array(lengths), 20)
    assert sorted(room.tolist()) == greedy(lengths, 20)
    assert offset.tolist() == [sum(n for n, s in zip(lengths[:k], sequence[:k]) if s == sequence[k]) for k in range(len(lengths))]


def gapless(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_sequences_give_the_documents_back(docs, vocabulary):
    texts = {1: None, 2: "", 3: "Hello, World! " * 7, 4: "один два " * 40, 5: "x", 6: "<|endoftext|> here"}
    frame = docs([(k, t, "clash", 1) for k, t in texts.items()] + [(5, "x", "clash", 1), (None, "no id", None, None)], "doc_id long, text string, ids string, row int")
    parts = pieces(frame, vocabulary, capacity=16, with_ids=True)
    rows = parts.collect()
    for doc_id, text in texts.items():
        ids, mine = whole(text), sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["piece"])
        expected = [(k, 16 * k, ids[16 * k : 16 * k + 16]) for k in range(-(-len(ids) // 16))]
        assert [(r["piece"], r["start"], r["ids"]) for r in mine] == [e for e in expected for _ in range(1 + (doc_id == 5))]
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) for r in mine)
    placed = pack(parts.drop("ids"), 16)
    assert gapless(placed.collect(), 16) == -(-sum(r["length"] for r in rows) // 16)
    back = defaultdict(list)
    for r in sequences(placed, parts).collect():
        assert len(r["ids"]) == sum(d["length"] for d in r["documents"]) <= 16
        for d in r["documents"]:
            back[d["doc_id"]].append((d["start"], r["ids"][d["offset"] : d["offset"] + d["length"]]))
    for doc_id, text in texts.items():
        if doc_id != 5:
            assert sum((ids for _, ids in sorted(back[doc_id])), []) == whole(text)


@pytest.mark.parametrize("many", [1, 4])
def test_many_groups_come_near_the_least_number(docs, many):
    draw = random.Random(2)
    lengths = [draw.choice([4096, *[3000] * many, *(draw.randint(1, 800) for _ in range(6))]) for _ in range(6000)]
    placed = pack(docs(list(enumerate(lengths)), "row long, length long"), group=500).collect()
    assert sorted((r["row"], r["length"]) for r in placed) == list(enumerate(lengths))
    least = max(-(-sum(lengths) // 4096), sum(n > 2048 for n in lengths))
    assert least <= gapless(placed, 4096) <= least + 3
    # Pieces that cannot share a sequence: one each, and packing them again ends at once.
    assert gapless(pack(docs([(k, 3000) for k in range(2000)], "row long, length long"), group=500).collect(), 4096) == 2000


def test_empty_table_and_very_long_text(docs, vocabulary):
    assert pack(pieces(docs([]), vocabulary)).collect() == []
    long = "several words " * 100_000
    rows = pieces(docs([(1, long)]), vocabulary).collect()
    assert sum(r["length"] for r in rows) == 200_001 and max(r["piece"] for r in rows) == 200_001 // 4096
