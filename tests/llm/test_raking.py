import itertools

import pytest

from rowloom.llm.raking import calibrated, cells_of, mixture, rake, sample


def corpus():
    rows = []
    for k in range(400):
        text = ("word " * (1 + k % 13)).strip() + (" | cell" if k % 5 == 0 else " me@x.y" if k % 7 == 0 else "")
        rows.append((k, text, ["en", "de", "fr", None][k % 4 if k % 3 else 0], "big" if k % 3 else f"s{k % 5}", 0))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_tokens long"


def by_hand(cells, targets, sweeps=200):
    weight = dict.fromkeys(cells, 1.0)
    total = sum(cells.values())
    for _ in range(sweeps):
        for d, target in targets.items():
            present = {k[d] for k, n in cells.items()}
            whole = sum(v for k, v in target.items() if k in present)
            now = {v: sum(cells[k] * weight[k] for k in cells if k[d] == v) for v in present}
            for k in cells:
                weight[k] *= target.get(k[d], 0) / whole * total / now[k[d]] if now[k[d]] else 0
    return weight


def test_against_raking_by_hand(docs):
    _, cells = cells_of(docs(corpus(), SCHEMA))
    counted = {(r["source"], r["lang"], r["topic"]): r["tokens"] for r in cells.collect()}
    targets = [{"big": 1.0, "s0": 1.0, "s1": 2.0, "s3": 1.0, "s4": 0.0, "absent": 9.0}, {"en": 0.5, "de": 0.2, "fr": 0.2, "unknown": 0.1}, {"table": 1.0, "contact": 1.0, "prose": 2.0}]
    given = {name: docs(list(t.items()), "value string, share double") for name, t in zip(("source", "lang", "topic"), targets)}
    raked = {(r["source"], r["lang"], r["topic"]): r["weight"] for r in rake(cells, given, sweeps=200, tolerance=1e-10).collect()}
    expected = by_hand(counted, dict(enumerate(targets)))
    assert raked.keys() == expected.keys()
    assert all(abs(raked[k] - expected[k]) < 1e-6 for k in raked)


def test_probabilities_meet_the_share(docs):
    thin, cells = cells_of(docs(corpus(), SCHEMA))
    rows = calibrated(rake(cells, {"lang": docs([("en", 1.0), ("de", 1.0), ("fr", 1.0), ("unknown", 1.0)], "value string, share double")}), 0.5).collect()
    total = sum(r["tokens"] for r in rows)
    assert abs(sum(r["tokens"] * r["probability"] for r in rows) / total - 0.5) < 1e-6
    for a, b in itertools.combinations([r for r in rows if 0 < r["probability"] < 1], 2):
        assert abs(a["probability"] / b["probability"] - a["weight"] / b["weight"]) < 1e-6


def test_sample_is_what_mixture_selects(docs):
    rows = docs(corpus() + [(None, None, None, None, None), (5, "again", "en", "big", 1)], SCHEMA)
    chosen = sorted((str(r["doc_id"]) for r in mixture(rows).where("selected").collect()))
    drawn = sample(rows)
    assert drawn.columns == rows.columns
    assert sorted(str(r["doc_id"]) for r in drawn.collect()) == chosen
    assert 0.3 < len(chosen) / 400 < 0.7


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "", "en", "a", 0)]])
def test_nothing_to_weigh(docs, rows):
    out = mixture(docs(rows, SCHEMA)).collect()
    assert len(out) == len(rows) and all(r["n_tokens"] == 0 and not r["selected"] for r in out)


def test_native(docs):
    plan = mixture(docs(corpus()[:20], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
