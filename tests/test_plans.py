"""Plan shapes: what is pushed to the scan, what is shuffled, what stays compiled."""

import contextlib
import io

import pytest

from rowloom.operators.drill import drill, key_path
from rowloom.session import shared_folder
from rowloom.sources import scan
from rowloom.sources.jsonl import read_lines
from rowloom.sources.scan import with_position
from rowloom.suite import QUERIES
from rowloom.suite.json_cells import order_lines
from rowloom.suite.registry import table
from rowloom.plans.apply import apply_recipe
from rowloom.recipes import Delete, where

SF = "/root/testdata/sf0.001"


def plan_of(frame):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


NARROW = [
    "recipe_passthrough", "recipe_chained", "recipe_lineitem_report", "filter_text_contains", "filter_num_text_mixed", "filter_ts_text",
    "view_cast_ts", "drill_scalar", "drill_nested_arrays", "drill_mixed_leaf", "json_display", "json_exact_text", "recipe_on_lines",
    "csv_round_trip", "jsonl_scan", "flatten_object", "explode_array", "json_children", "drill_each_node",
]


@pytest.mark.parametrize("name", NARROW)
def test_no_shuffle(spark, name):
    if name == "drill_mixed_leaf":
        pytest.importorskip("pyarrow")
    plan = plan_of(QUERIES[name](spark, SF))
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("name", QUERIES)
def test_no_cross_join(spark, name):
    if name.startswith("stream_"):
        pytest.skip("runs the stream")
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_typed_filters_reach_the_scan(spark):
    tests = [
        where("l_quantity", "GreaterThan", "20", "Number"), where("l_shipdate", "LessThan", "1998-01-01", "Timestamp"),
        where("l_linenumber", "LessThanOrEqual", "3.5", "Number"), where("l_orderkey", "Equals", "5", "Number"),
    ]
    plan = plan_of(apply_recipe(table(spark, SF, "lineitem"), [*tests, Delete("l_tax")]))
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    for part in ("GreaterThan(l_quantity,20.0)", "LessThan(l_shipdate,1998-01-01T00:00)", "LessThanOrEqual(l_linenumber,3)", "EqualTo(l_orderkey,5)"):
        assert part in pushed
    assert "l_tax" not in next(line for line in plan.splitlines() if line.startswith("ReadSchema"))


def test_caseless_values_reach_the_scan(spark):
    plan = plan_of(apply_recipe(table(spark, SF, "orders"), [where("o_orderpriority", "StartsWith", "5-")]))
    assert "StringStartsWith(o_orderpriority,5-)" in plan


def test_filled_columns_are_not_read(spark):
    plan = plan_of(QUERIES["recipe_chained"](spark, SF))
    assert "o_orderpriority" not in next(line for line in plan.splitlines() if line.startswith("ReadSchema"))


def test_profiles_aggregate_before_the_shuffle(spark):
    for name in ("schema_csv_nullable", "schema_jsonl", "json_keys_union"):
        plan = plan_of(QUERIES[name](spark, SF))
        assert plan.count("HashAggregate") >= 2 and "SortAggregate" not in plan.split("Window")[0]


def test_drill_parses_each_record_once(spark):
    """Once as it stands, once more only for lines written anew."""
    frame = drill(order_lines(spark, SF), key_path("facts"), schema=["name", "text"])
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(line") + plan.count("try_parse_json(line") <= 1


def test_positions_of_many_splits_shuffle_no_text(spark, monkeypatch, text_file):
    """100 TB are about 800,000 splits of 128 MB."""
    monkeypatch.setattr(scan, "split_bound", lambda df: 800_000)
    frame = with_position(read_lines(spark, text_file("many.txt", "a\nb\nc\n")))
    assert sorted((r.line, r.position) for r in frame.collect()) == [("a", 1), ("b", 2), ("c", 3)]
    plan = plan_of(frame)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_no_local_folder_on_a_cluster():
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()
        sparkContext = type("Context", (), {"master": "yarn", "getConf": lambda self: type("C", (), {"get": lambda self, key: None})()})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Cluster())
