import pytest

from rowloom.llm.quotes import link_quotes, parse, with_quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def test_parse():
    assert parse("> > deep one\n>> deep two\n> near\nmine\n\n> again") == ("mine", [(2, ["deep one", "deep two"]), (1, ["near"]), (1, ["again"])])
    assert parse(None) == parse("") == ("", [])
    assert parse("a > b\n->x") == ("a > b\n->x", [])


def linked(docs, rows):
    return {(r["conv_id"], r["turn"]): r for r in link_quotes(docs(rows, SCHEMA)).collect()}


def test_links_and_threads(docs):
    rows = [
        (1, 0, "user", "How do I sort a table?\nIt is long."), (1, 1, "assistant", "> How do I sort a table?\nUse sort by key."),
        (1, 2, "user", ">> It is long.\n>  use SORT by   key.\nThanks a lot"), (1, 3, "user", "Something else"), (1, 4, "assistant", "> unknown words\n> Something else\nSure"),
        (2, 0, "user", "> Thanks a lot\nfrom elsewhere"), (2, 1, "user", "Something else"), (2, 2, "x", "> Something else\nhere"), (3, 0, None, None), (3, 1, "u", ""), (3, 2, "u", "> later\n"), (3, 3, "u", "later"),
    ]
    found = linked(docs, rows + [rows[0], (None, 1, "u", "lost")])
    reply = {k: (r["reply_conv"], r["reply_turn"]) for k, r in found.items()}
    none = (None, None)
    assert reply == {
        (1, 0): none, (1, 1): (1, 0), (1, 2): (1, 1), (1, 3): none, (1, 4): (1, 3), (2, 0): (1, 2), (2, 1): none, (2, 2): (2, 1), (3, 0): none, (3, 1): none, (3, 2): none, (3, 3): none,
    }
    assert [(found[k]["thread_conv"], found[k]["thread_turn"], found[k]["depth"]) for k in ((1, 2), (2, 0), (1, 4), (3, 0))] == [(1, 0, 2), (1, 0, 3), (1, 3, 1), (3, 0, 0)]
    assert found[1, 2]["text"] == "Thanks a lot" and found[1, 2]["quote_levels"] == 2 and found[1, 4]["n_unlinked"] > 0
    assert found[3, 0]["text"] is None and found[3, 1]["text"] == ""


def test_long_thread(docs):
    rows = [(1, 0, "u", "message 0")] + [(1, k, "u", f"> message {k - 1}\nmessage {k}") for k in range(1, 70)]
    found = linked(docs, rows)
    assert all((r["thread_turn"], r["depth"]) == (0, k) for (_, k), r in found.items())


def test_round_trip_of_quoted_conversations(docs, spark):
    plain = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    texts = {(r["conv_id"], r["turn"]): r["text"] for r in plain.collect()}
    found = link_quotes(with_quotes(plain)).collect()
    assert {(r["conv_id"], r["turn"]): r["text"] for r in found} == {k: t.strip("\n") for k, t in texts.items()}
    for r in found:
        if r["quote_levels"]:
            assert (r["reply_conv"], r["reply_turn"]) == (r["conv_id"], r["turn"] - 1)
        assert r["n_unlinked"] == 0


@pytest.mark.parametrize("rows", [[], [(1, 1, "u", "> only a quote")]])
def test_small_tables(docs, rows):
    found = linked(docs, rows)
    assert [(r["text"], r["reply_turn"], r["depth"]) for r in found.values()] == [("", None, 0)] * len(rows)
