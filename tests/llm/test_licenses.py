import random

import pytest
from llm.words import invented

from rowloom.llm.licenses import TEMPLATES, find_licenses

KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text):
    return (text or "").encode().translate(KEPT).split()


def grams(w):
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute(rows):
    """Documents that hold 80 % of a template's shingles close together."""
    out = set()
    longest = max(len(words(t)) for t in TEMPLATES.values())
    for doc, text in rows:
        w = words(text)
        for name, template in TEMPLATES.items():
            wanted = grams(words(template))
            best = max((len(wanted & grams(w[max(0, at - longest) : at - longest + 2 * longest + 8 if at > longest else 2 * longest + 8])) for at in range(len(w))), default=0)
            if best >= 0.8 * len(wanted):
                out.add((doc, name))
    return out


def corpus():
    draw, rows = random.Random(6), []
    names = list(TEMPLATES)
    for number in range(60):
        text = invented(number, draw.randint(0, 120))
        for name in draw.sample(names, draw.choice([0, 1, 1, 2])):
            notice = TEMPLATES[name].split()
            if draw.random() < 0.3 and len(notice) > 20:
                notice[draw.randrange(len(notice))] = "changed"
            text += [*notice, *invented(number + 500, draw.randint(0, 30))]
        rows.append((number, " ".join(text).upper() if number % 7 == 0 else " ".join(text)))
    return rows + [(100, None), (101, ""), (102, "License"), (103, "mit license"), (104, TEMPLATES["MIT notice"])]


def test_against_brute_force(docs):
    rows = corpus()
    found = find_licenses(docs(rows + [(104, TEMPLATES["MIT notice"])]))
    assert {(r["doc_id"], r["license"]) for r in found.collect()} == brute(rows)
    assert found.where("containment < 0.8 or containment > 1 or first_word < 0").count() == 0


def test_native_and_empty(docs, spark):
    plan = find_licenses(docs([(1, "x", "y")], "doc_id long, text string, license string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert find_licenses(docs([])).collect() == []
    assert find_licenses(docs([(1, "a b c d e f")]), spark.createDataFrame([("short", "a b c"), (None, "a b c d e")], "license string, text string")).collect() == []


def test_too_many_templates(docs, spark, monkeypatch):
    monkeypatch.setattr("rowloom.llm.licenses.MOST_BANDS", 3)
    with pytest.raises(ValueError):
        find_licenses(docs([(1, "a")]), spark.createDataFrame([("x", " ".join(invented(1, 40)))], "license string, text string"))
