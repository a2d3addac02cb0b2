import collections
import random

from llm.words import invented

from rowloom.llm.quality import POLICIES, RULES, ablations, apply_policy, ledger


def measures(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    count = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if count[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines = [line for line in text.split("\n") if line.encode().split()]
    return (
        len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(covered), sum(c.isupper() and len(c.upper()) == 1 for c in text),
    )


def corpus():
    draw = random.Random(2)
    texts = [None, "", " \t\n\u000b\f\r ", "a", "a b c d e", "a b c d e a b c d e", "a " * 9, "a " * 50, "x\ny\nx\n\n\ny\nx", "one word", "##** $% a|b <c>", "ÄÖÜ GROSS Klein ñ"]
    for k in range(40):
        words = invented(k, draw.randint(1, 60), 12)
        texts.append("\n".join(" ".join(words[i : i + 6]) for i in range(0, len(words), 6)))
    return [(k, text) for k, text in enumerate(texts)] + [(3, "a"), (None, "b c")]


def test_measures_against_brute_force(docs):
    rows = corpus()
    found = sorted((tuple(r)[:8] for r in ledger(docs(rows)).collect()), key=str)
    assert found == sorted(((i, *measures(t)) for i, t in rows), key=str)


def test_bits_and_policies(docs):
    rows = ledger(docs(corpus()))
    for row in apply_policy(rows, "v2").collect():
        bits = row["failed_bits"]
        assert bool(bits & 1) == (row["n_words"] < 10) and bool(bits & 2) == (100 * row["n_repeat_words"] > 20 * row["n_words"])
        assert row["kept"] == (bits & POLICIES["v2"] == 0)


def test_ablations(docs):
    rows = ledger(docs(corpus()))
    bits = [r["failed_bits"] for r in rows.collect()]
    for row in ablations(rows).collect():
        mask, bit = POLICIES[row["version"]], 1 << [r for r, _ in RULES].index(row["rule"])
        expected = [sum(bool(b & bit) for b in bits), sum(b & mask == bit for b in bits), sum(b & mask == 0 for b in bits), sum(b & mask & ~bit == 0 for b in bits)]
        assert [row["n_failed"], row["n_alone"], row["n_kept"], row["n_kept_without"]] == expected


def test_native_and_empty(docs):
    assert ledger(docs([])).collect() == []
    plan = ledger(docs([(1, "x", 5)], "doc_id long, text string, n_words long"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_very_long_text(docs):
    words = invented(1, 40_000, 9)
    (row,) = ledger(docs([(1, " ".join(words))])).collect()
    assert tuple(row)[1:8] == measures(" ".join(words))
