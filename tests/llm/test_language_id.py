import numpy as np

from rowloom.llm.language_id import best_paths, keep_known, label, learn, paths_of, script

ENGLISH = "the quick brown fox jumps over the lazy dog and then it was there with the others which they thought should have been".split()
GERMAN = "der schnelle braune fuchs springt über den faulen hund und dann ist es nicht mehr da weil sie gedacht haben müssten".split()
RUSSIAN = "быстрая коричневая лиса прыгает через ленивую собаку и потом она была там с другими которые думали".split()


def labelled(docs):
    rows = [(" ".join(words[k % 7 :] + words[: k % 7]), lang) for words, lang in ((ENGLISH, "en"), (GERMAN, "de"), (RUSSIAN, "ru")) for k in range(10)]
    return docs(rows + [(None, "en"), ("text", None)], "text string, lang string")


def test_labels_and_spans(docs):
    rows = [(1, " ".join(ENGLISH)), (2, " ".join(GERMAN)), (3, "лиса была там"), (4, " ".join(ENGLISH[:9] + GERMAN[:12])), (5, None), (6, ""), (7, "12 34 ..."), (8, "THE FOX"), (8, "THE FOX"), (9, "漢字")]
    found = {r["doc_id"]: r for r in label(docs(rows), learn(labelled(docs))).collect()}
    assert [found[k]["lang_pred"] for k in (1, 2, 3, 8)] == ["en", "de", "ru", "en"]
    assert [(s["lang"], s["first"], s["words"]) for s in found[4]["spans"]] == [("en", 0, 9), ("de", 9, 12)]
    assert found[4]["score"] == 12 / 21
    assert all((found[k]["lang_pred"], found[k]["score"], found[k]["spans"]) == ("und", 0.0, []) for k in (5, 6, 7))
    assert found[9]["lang_pred"] in {"en", "de", "ru"}  # has letters, in no script that was learned


def test_keeps_all_columns(documents, docs):
    rows = documents([(1, " ".join(ENGLISH)), (2, None), (3, "..."), (4, " ".join(GERMAN))])
    kept = keep_known(rows, learn(labelled(docs)))
    assert kept.columns == rows.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 4]


def test_held_out_accuracy(spark):
    data = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = learn(data.where("doc_id % 4 <> 2").select("text", "lang"))
    held = data.where("doc_id % 4 = 2")
    found = dict(label(held, model).select("doc_id", "lang_pred").collect())
    truth = dict(held.select("doc_id", "lang").collect())
    assert sum(found[k] == truth[k] for k in truth) >= 0.95 * len(truth)


def test_empty_tables(docs):
    nothing = learn(docs([], "text string, lang string"))
    assert nothing.languages == []
    assert label(docs([]), nothing).collect() == []
    assert [tuple(r)[1:3] for r in label(docs([(1, "some text")]), nothing).collect()] == [("und", 0.0)]


def test_paths_against_all_paths():
    draw = np.random.default_rng(1)
    table = np.log(draw.random((20, 3))).astype(np.float32)
    rows = [draw.integers(0, 20, n) for n in (6, 0, 1, 4, 6)]

    def value(row, path):
        return table[row, path].sum() - 0.7 * (np.diff(path) != 0).sum()

    for row, path in zip(rows, best_paths(rows, table, 0.7)):
        every = np.array(np.meshgrid(*[range(3)] * len(row))).reshape(len(row), -1).T if len(row) else []
        assert len(path) == len(row)
        assert not len(row) or abs(value(row, path) - max(value(row, p) for p in every)) < 1e-4


def test_texts_that_stay_with_one_language_need_no_search():
    """The shortcut gives the paths of the full search, for all lengths and strengths."""
    draw = np.random.default_rng(2)
    one = 0
    for strength in (0.05, 0.2, 0.5, 2.0):
        table = -strength * draw.random((50, 4)).astype(np.float32)
        table[:, 1] *= draw.choice([0.2, 1.0])
        rows = [draw.integers(0, 50, n) for n in draw.integers(0, 120, 60)]
        full, short = best_paths(rows, table, 3.0), paths_of(rows, table, 3.0)
        for row, path, other in zip(rows, full, short):
            one += len(row) > 0 and len(set(path)) == 1
            values = [table[row, p].sum() - 3.0 * (np.diff(p) != 0).sum() for p in (path, other)]
            assert len(path) == len(other) and abs(values[0] - values[1]) < 1e-3
    assert one > 40


def test_marks_without_a_letter_are_no_words(docs):
    rows = docs([(1, "1️⃣ 2️⃣"), (2, "̈ ́"), (3, "1️⃣ THE FOX ️"), (4, "e\u0301")])
    found = {r["doc_id"]: (r["lang_pred"], r["n_letter_words"]) for r in label(rows, learn(labelled(docs))).collect()}
    assert found[1] == found[2] == ("und", 0) and found[3] == ("en", 2) and found[4][1] == 1


def test_ties_long_texts_and_clashing_columns(docs):
    model = learn(labelled(docs))
    # Half of the words each: of equal shares the first language by name.
    tie = " ".join(ENGLISH[:12] + GERMAN[:12])
    long = " ".join(ENGLISH) + " " + " ".join(GERMAN * 20_000)
    rows = docs([(1, tie, "x", 1.0, "s"), (2, long, "x", 2.0, "s"), (2, long, None, None, None)], "doc_id long, text string, lang_pred string, score double, spans string")
    found = [tuple(r) for r in label(rows, model).collect()]
    assert found[0][1:3] == ("de", 0.5) and found[1] == found[2] and found[1][1] == "de" and len(found[1][4]) == 2
    assert sorted(r["row"] for r in keep_known(rows.withColumnRenamed("score", "row"), model, 0.4).where("row is not null").select("row").collect()) == [1.0, 2.0]


def test_scripts():
    assert script("a") != script("я") != script("漢") and script("é") == script("z")
