"""The registered corpus queries: those with SQL against DuckDB, all of them by columns."""

import __spark_entry__ as entry
import pytest
from compare import difference, duck

from rowloom.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op2": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op4": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op8": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op9": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op10": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op11": {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"},
}


@pytest.mark.parametrize("name", SQL)
def test_against_sql(spark, name):
    assert difference(spark, duck(SF), QUERIES[name], SQL[name], SF) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_rows_and_columns(spark, name):
    frame = QUERIES[name](spark, SF)
    assert COLUMNS.get(name.split("_")[0], {}).items() <= dict(frame.dtypes).items()
    if name.split("_")[0] in COLUMNS:
        assert frame.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    else:
        assert not frame.isEmpty()


def test_all_are_registered():
    assert QUERIES.keys() | {"pipeline"} <= entry.queries().keys()
    assert SQL.keys() <= entry.oracle_sql().keys()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
