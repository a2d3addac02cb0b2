import random

import corpus_pipeline
from llm.test_decontaminate import words as alnum
from llm.test_ngram_join import brute as groups
from llm.test_substring_dedup import brute as repeats

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    known = stages["language_id"](spark, docs, SF).cache()
    assert known.columns == columns and known.count() >= 0.95 * docs.count()

    rows = [(r["doc_id"], r["text"]) for r in known.collect()]
    expected = {i for i, _, least, _ in groups(rows, 5, 80) if i == least}
    single = stages["ngram_jaccard_join"](spark, known, SF).cache()
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(expected)

    rows = [(r["doc_id"], r["text"]) for r in single.collect()]
    wanted = {doc: total - gone for doc, total, gone, _ in repeats(rows) if gone == 0 or gone < total}
    cut = stages["substring_dedup"](spark, single, SF).cache()
    assert cut.columns == columns and {r["doc_id"]: len(r["text"].encode().split()) for r in cut.collect()} == wanted

    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = alnum(r["text"])
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    sizes = {len(g) for g in windows}
    clean = {r["doc_id"] for r in cut.collect() if not any(tuple(w[k : k + n]) in windows for w in [alnum(r["text"])] for n in sizes for k in range(len(w) - n + 1))}
    left = stages["benchmark_decontamination"](spark, cut, SF).cache()
    assert left.columns == columns and {r["doc_id"] for r in left.collect()} == clean
    assert stages["source_mixing"](spark, left, SF).count() <= left.count()


def test_run_is_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def test_stages_on_odd_rows(spark, documents):
    draw = random.Random(1)
    text = " ".join(draw.choice(["the", "of", "and", "house", "tree"]) for _ in range(60))
    odd = documents([(1, text), (1, text), (2, text), (None, None), (3, None), (4, ""), (5, "x", None, None)])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns
        out.collect()
        assert stage(spark, odd.where("false"), SF).collect() == []
    kept = corpus_pipeline.join_near_copies(spark, odd, SF).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "3", "4", "5", "None"]


def test_rows_that_share_a_doc_id(spark, documents):
    """Copies go by row: a text of its own stays, whatever doc_id it shares."""
    draw = random.Random(3)
    one, two, three = (" ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(80)) for _ in range(3))
    rows = documents([(3, one), (7, one), (7, two), (5, two + " end"), (9, three), (9, "other " + three[6:]), (None, three), (None, "a text of its own and no number at all")])
    kept = sorted((r["doc_id"] or 0, r["text"][:12]) for r in corpus_pipeline.join_near_copies(spark, rows, SF).collect())
    assert kept[0] == (0, "a text of it") and kept[1:3] == [(3, one[:12]), (5, two[:12])]
    assert len(kept) == 4 and kept[3][0] == 9
    apart = documents([(3, one), (7, one), (7, two), (5, one), (5, three)])
    assert sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.join_near_copies(spark, apart, SF).collect()) == sorted([(3, one), (7, two), (5, three)])
