"""JSON member functions and drill-down, on JSON lines made from table rows.

Every record is made from one row, so no rows are gathered to build a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import json_cells as J
from ..functions.types import ColumnType
from ..operators.drill import (
    apply_to_drilled, drill, drill_node, drill_single, index, infer_leaves, json_children, key, key_path, leaf_table, structure_profile,
)
from ..operators.flatten import explode_array, flatten_object
from ..plans.apply import project
from ..plans.cells import json_string
from ..plans.run import recipe_over_lines
from ..recipes import Cast, Delete, Fill, Rename, where
from ..sinks.files import write_json_object
from ..sources.json_documents import read_json_object
from ..sources.jsonl import records, with_cells, with_shown
from .registry import query, table, written


def event_lines(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("position"), F.col("props").alias("line"))


def order_lines(spark, sf) -> DataFrame:
    """{"id", "customer": {"key", "status"}, "facts": [{...}, {...}], "paid": bool}"""
    facts = F.array(
        F.struct(F.lit("priority").alias("name"), F.col("o_orderpriority").alias("text")),
        F.struct(F.lit("day").alias("name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("text")),
    )
    record = F.struct(
        F.col("o_orderkey").alias("id"),
        F.struct(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status")).alias("customer"),
        facts.alias("facts"),
        (F.col("o_totalprice") > 250000).alias("paid"),
    )
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("position"), F.to_json(record).alias("line"))


def word_lines(spark, sf) -> DataFrame:
    """{"id", "words": [...]} per part."""
    record = F.struct(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("words"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("position"), F.to_json(record).alias("line"))


def paragraph_lines(spark, sf) -> DataFrame:
    """{"paragraphs": [{"lines": [...]}, ...]} per conversation turn, whole texts."""
    paragraphs = F.transform(F.split("text", "\n"), lambda p: F.struct(F.split(p, ", ").alias("parts")))
    return table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("position"), F.to_json(F.struct(paragraphs.alias("paragraphs"))).alias("line")
    )


def uneven_lines(spark, sf) -> DataFrame:
    """One key whose value is an object, an array, a text, null, absent or broken,
    by order priority and, for the lowest one, by status."""
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    value = (
        F.when(priority == "1-URGENT", F.to_json(F.struct(status.alias("status"))))
        .when(priority == "2-HIGH", F.concat(F.lit('[{"status":"'), status, F.lit('"},5,null]')))
        .when(priority == "3-MEDIUM", json_string(status))
        .when(priority == "4-NOT SPECIFIED", "null")
    )
    line = (
        F.when(value.isNotNull(), F.concat(F.lit('{"leaf":'), value, F.lit("}")))
        .when(status == "F", '{"other":1}')
        .otherwise('{"leaf":{"status":')
    )
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("position"), line.alias("line"))


# --------------------------------------------------------------- cell functions

@query(
    "json_display",
    """select o_orderkey as position, cast(o_orderkey as varchar) as id, '{Object: 2 properties}' as customer,
              '[Array: 2 items]' as facts, case when o_totalprice > 250000 then 'True' else 'False' end as paid,
              '<null>' as nothing from orders""",
)
def json_display(spark, sf):
    names = ["id", "customer", "facts", "paid", "nothing"]
    shown = with_shown(records(order_lines(spark, sf)), names)
    return shown.select("position", *(F.col(f"shown_{i}").alias(n) for i, n in enumerate(names)))


@query(
    "json_preview",
    """select p_partkey as position, '[Array: ' || len(string_split(p_name, ' ')) || ' items]' as words from part""",
)
def json_preview(spark, sf):
    rows = records(word_lines(spark, sf))
    return rows.select("position", J.preview(J.member(F.col("record"), "words")).alias("words"))


@query(
    "json_kinds",
    """select case o_orderpriority when '1-URGENT' then 'object' when '2-HIGH' then 'array' when '3-MEDIUM' then 'string'
              when '4-NOT SPECIFIED' then 'null' end as kind, count(*) as records from orders group by 1""",
)
def json_kinds(spark, sf):
    rows = records(uneven_lines(spark, sf))
    kinds = rows.select(J.kind(J.member(F.col("record"), "leaf")).alias("kind"))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("records"))


@query(
    "json_presence",
    """select o_orderkey as position, case when o_orderpriority = '4-NOT SPECIFIED' then 'null' when o_orderpriority <> '5-LOW' then 'value'
              when o_orderstatus = 'F' then 'missing' else 'invalid' end as presence from orders""",
)
def json_presence(spark, sf):
    rows = records(uneven_lines(spark, sf))
    return rows.select("position", J.presence(F.col("line"), F.col("record"), "leaf").alias("presence"))


@query(
    "json_exact_text",
    """select o_orderkey as position, printf('%.3f', o_totalprice) as amount,
              '{ "z": ' || o_custkey || '.0, "a": [ 1e2 ] }' as nested from orders""",
)
def json_exact_text(spark, sf):
    """Numbers and nested values keep their spelling, spaces and member order."""
    line = F.format_string('{"amount": %.3f, "nested": { "z": %d.0, "a": [ 1e2 ] }}', "o_totalprice", "o_custkey")
    lines = table(spark, sf, "orders").select(F.col("o_orderkey").alias("position"), line.alias("line"))
    read = with_cells(records(lines), ["amount", "nested"])
    return read.select("position", F.col("cell_0.text").alias("amount"), F.col("cell_1.text").alias("nested"))


# ------------------------------------------------------------------- drill-down

@query("drill_object", """select cast(event_id as varchar) as "#", json_extract_string(props, '$.k') as k from events""")
def drill_object(spark, sf):
    return drill(event_lines(spark, sf), [])


@query("drill_scalar", """select cast(event_id as varchar) as "#", json_extract_string(props, '$.k') as k from events""")
def drill_scalar(spark, sf):
    return drill(event_lines(spark, sf), [key("k")], schema=["k"])


@query("drill_nested_object", """select cast(o_orderkey as varchar) as "#", cast(o_custkey as varchar) as key, o_orderstatus as status from orders""")
def drill_nested_object(spark, sf):
    return drill(order_lines(spark, sf), key_path("customer"))


@query(
    "drill_array_objects",
    """select o_orderkey || ':0' as "#", 'priority' as name, o_orderpriority as text from orders
       union all select o_orderkey || ':1', 'day', strftime(o_orderdate, '%Y-%m-%d') from orders""",
)
def drill_array_objects(spark, sf):
    return drill(order_lines(spark, sf), key_path("facts"))


@query(
    "drill_array_scalars",
    """select p_partkey || ':' || (i - 1) as "#", w as value
       from part, unnest(string_split(p_name, ' ')) with ordinality u(w, i)""",
)
def drill_array_scalars(spark, sf):
    return drill(word_lines(spark, sf), key_path("words"), schema=["value"])


@query(
    "drill_trailing_index",
    """select p_partkey || ':' || (i - 1) as "#", w as value
       from part, unnest(string_split(p_name, ' ')) with ordinality u(w, i)""",
)
def drill_trailing_index(spark, sf):
    return drill(word_lines(spark, sf), [key("words"), index(0)], schema=["value"])


@query(
    "drill_nested_arrays",
    """with p as (select conv_id || '-' || turn as id, i - 1 as i, p
                  from conversations, unnest(string_split(text, chr(10))) with ordinality u(p, i))
       select id || ':' || i || ':' || (j - 1) as "#", w as value
       from p, unnest(string_split(p.p, ', ')) with ordinality v(w, j)""",
)
def drill_nested_arrays(spark, sf):
    return drill(paragraph_lines(spark, sf), key_path("paragraphs", 0, "parts"), schema=["value"])


@query(
    "drill_mixed_leaf",
    """with u as (select cast(o_orderkey as varchar) as k, o_orderstatus as s, o_orderpriority as p from orders)
       select k as "#", s as status, '<null>' as value, '<null>' as leaf from u where p = '1-URGENT'
       union all select k || ':0', s, '<null>', '<null>' from u where p = '2-HIGH'
       union all select k || ':1', '<null>', '5', '<null>' from u where p = '2-HIGH'
       union all select k || ':2', '<null>', '<null>', '<null>' from u where p = '2-HIGH'
       union all select k, '<null>', '<null>', s from u where p = '3-MEDIUM'
       union all select k, '<null>', '<null>', '<null>' from u where p = '4-NOT SPECIFIED'""",
)
def drill_mixed_leaf(spark, sf):
    """Objects, arrays, plain values and nulls under one key, broken lines skipped."""
    return drill(uneven_lines(spark, sf), key_path("leaf"))


@query(
    "drill_malformed_fails",
    """with u as (select o_orderpriority as priority, o_orderstatus <> 'F' and o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') as broken,
              case o_orderpriority when '2-HIGH' then 3 when '5-LOW' then 0 else 1 end as reached from orders)
       select priority, bool_or(broken) as failed, case when bool_or(broken) then null else sum(reached) end as rows from u group by 1""",
)
def drill_malformed_fails(spark, sf):
    """Lines of each priority drilled so that one which is no JSON fails the run."""
    priorities = table(spark, sf, "orders").select(F.col("o_orderkey").alias("position"), "o_orderpriority")
    lines = uneven_lines(spark, sf).join(priorities, "position")
    found = []
    for (priority,) in priorities.select("o_orderpriority").distinct().collect():
        reached = drill(lines.where(F.col("o_orderpriority") == priority).select("position", "line"), key_path("leaf"), schema=["status", "value", "leaf"], on_error="fail")
        try:
            found.append((priority, False, reached.count()))
        except Exception as error:  # noqa: BLE001
            if "Not JSON" not in str(error):
                raise
            found.append((priority, True, None))
    return spark.createDataFrame(found, "priority string, failed boolean, rows long")


@query("drill_missing_skipped", """select cast(o_orderkey as varchar) as "#", o_orderstatus as status from orders where o_orderpriority = '1-URGENT'""")
def drill_missing_skipped(spark, sf):
    return drill(uneven_lines(spark, sf), key_path("leaf", "status"), schema=["status"])


@query(
    "drill_text_cells",
    """select cast(o_orderkey as varchar) as "#", cast(o_orderkey as varchar) as id,
              '{"key":' || o_custkey || ',"status":"' || o_orderstatus || '"}' as customer,
              case when o_totalprice > 250000 then 'true' else 'false' end as paid from orders""",
)
def drill_text_cells(spark, sf):
    return drill(order_lines(spark, sf), [], schema=["id", "customer", "paid"], cells="text")


@query(
    "drill_then_filter",
    """select o_orderkey || ':0' as "#", 'priority' as what, o_orderpriority as text from orders
       where contains(lower(o_orderpriority), 'high')""",
)
def drill_then_filter(spark, sf):
    table_ = drill(order_lines(spark, sf), key_path("facts"), schema=["name", "text"])
    return apply_to_drilled(table_, [Rename("name", "what"), where("text", "Contains", "HIGH"), where("what", "Equals", "Priority"), Delete("#")])


@query(
    "drill_then_cast",
    """select cast(o_orderkey as varchar) as "#", cast(o_custkey as varchar) as key, '<invalid>' as status
       from orders where o_custkey > 500""",
)
def drill_then_cast(spark, sf):
    lines = order_lines(spark, sf)
    schema = infer_leaves(lines, key_path("customer"))
    actions = [where("key", "GreaterThan", "500", "Number"), Cast("status", ColumnType.BOOLEAN)]
    return apply_to_drilled(drill(lines, key_path("customer"), schema=schema), actions, schema)


@query(
    "drill_each_node",
    """select '[0]' as "#", cast(c_custkey as varchar) as id, 'segment' as name, c_mktsegment as text, '<null>' as extra from customer
       union all select '[1]', cast(c_custkey as varchar), 'nation', cast(c_nationkey as varchar), 'x' from customer""",
)
def drill_each_node(spark, sf):
    """One node per document, each an array of objects."""
    items = F.to_json(F.array(
        F.struct(F.lit("segment").alias("name"), F.col("c_mktsegment").alias("text"), F.lit(None).cast("string").alias("extra")),
        F.struct(F.lit("nation").alias("name"), F.col("c_nationkey").cast("string").alias("text"), F.lit("x").alias("extra")),
    ))
    nodes = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.try_parse_json(items).alias("record"))
    rows, _ = drill_node(nodes, keep=["id"])
    return leaf_table(rows, ["name", "text", "extra"], keep=["id"])


@query(
    "drill_single_node",
    """select 'table' as node, '[' || r.i || ']' as "#", n_name as name, cast(null as varchar) as error from
         (select n_name, row_number() over (order by n_nationkey) - 1 as i from nation where n_regionkey = 1) r
       union all select 'text', null, null, 'The node is no array.' from region where r_regionkey = 1
       union all select 'numbers', null, null, 'The array holds something else than objects.' from region where r_regionkey = 1
       union all select 'nothing', null, null, 'The array has no elements.' from region where r_regionkey = 1
       union all select 'blanks', null, null, 'What the path reaches has no members.' from region where r_regionkey = 1
       union all select 'broken', null, null, 'The node is not JSON.' from region where r_regionkey = 1""",
)
def drill_single_node(spark, sf):
    """Entries of a JSON Object file, each taken as the one chosen node: a table, or its error."""

    def write(path: str) -> None:
        names = table(spark, sf, "nation").where("n_regionkey = 1")
        ordered = F.array_sort(F.collect_list(F.struct("n_nationkey", F.col("n_name").alias("name"))))
        listed = names.groupBy("n_regionkey").agg(ordered.alias("all"))
        values = {
            "table": F.to_json(F.transform("all", lambda x: F.struct(x["name"].alias("name")))), "text": F.concat(F.lit('"'), F.col("all")[0]["name"], F.lit('"')),
            "numbers": F.to_json(F.transform("all", lambda x: x["n_nationkey"])), "nothing": F.lit("[]"), "blanks": F.lit("[{},{}]"),
        }
        entries = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()]))
        write_json_object(listed.select(entries.alias("e")).select("e.*").coalesce(1), path)

    entries = read_json_object(spark, written(spark, sf, "nodes-object", write))
    broken = table(spark, sf, "region").where("r_regionkey = 1").select(F.lit("broken").alias("key"), F.concat(F.lit("[{"), "r_name").alias("line"))
    out = None
    for name in ("table", "text", "numbers", "nothing", "blanks", "broken"):
        node = (broken if name == "broken" else entries.select("key", "line")).where(F.col("key") == name).select("line")
        try:
            found = drill_single(node).select(F.lit(name).alias("node"), "#", "name", F.lit(None).cast("string").alias("error"))
        except ValueError as error:
            found = node.select(F.lit(name).alias("node"), F.lit(None).cast("string").alias("#"), F.lit(None).cast("string").alias("name"), F.lit(str(error)).alias("error"))
        out = found if out is None else out.unionByName(found)
    return out


@query(
    "json_children",
    """select o_orderkey as position, 'key' as label, 'number' as kind, 'key: ' || o_custkey as display from orders
       union all select o_orderkey, 'status', 'string', 'status: "' || o_orderstatus || '"' from orders""",
)
def children(spark, sf):
    return json_children(order_lines(spark, sf), key_path("customer"))


@query(
    "json_structure",
    """select label, kind, count(*) as records from orders,
         (values ('id', 'number'), ('customer', 'object'), ('facts', 'array'), ('paid', 'boolean')) t(label, kind) group by 1, 2""",
)
def structure(spark, sf):
    return structure_profile(order_lines(spark, sf), [])


def repeating_lines(spark, sf) -> DataFrame:
    """{"id", "user": {"a", "a"}, "user": 0}: members named twice, on two levels, in two
    of three records."""
    again = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(',"a":"second"')
    user = F.when(F.col("o_orderkey") % 3 == 2, ',"user":0').otherwise("")
    line = F.concat(F.lit('{"id":'), "o_orderkey", F.lit(',"user":{"a":'), "o_custkey", again, F.lit("}"), user, F.lit("}"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("position"), line.alias("line"))


@query("drill_repeated_keys", """select cast(o_orderkey as varchar) as "#", cast(o_custkey as varchar) as a from orders""")
def drill_repeated_keys(spark, sf):
    return drill(repeating_lines(spark, sf), key_path("user"))


@query("json_presence_repeated", "select o_orderkey as position, 'value' as presence from orders")
def presence_repeated(spark, sf):
    rows = records(repeating_lines(spark, sf))
    return rows.select("position", J.presence(F.col("line"), F.col("record"), "user").alias("presence"))


@query("json_structure_repeated", "select label, kind, count(*) as records from orders, (values ('id', 'number'), ('user', 'object')) t(label, kind) group by 1, 2")
def structure_repeated(spark, sf):
    return structure_profile(repeating_lines(spark, sf), [])


# ------------------------------------------------------------ flatten, explode

@query(
    "flatten_object",
    """select o_orderkey as id, o_custkey as "customer.key", o_orderstatus as "customer.status" from orders""",
)
def flatten(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.struct(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status")).alias("customer")
    )
    return flatten_object(rows, "customer")


@query("explode_array", "select p_partkey as id, w as word, p_brand as brand from part, unnest(string_split(p_name, ' ')) u(w)")
def explode(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("word"), F.col("p_brand").alias("brand"))
    return explode_array(rows, "word")


@query(
    "recipe_on_lines",
    """select cast(o_orderkey as varchar) as "order", case when o_totalprice > 250000 then 'true' else 'false' end as paid,
              'same' as facts from orders where o_orderkey >= 1000""",
)
def recipe_on_lines(spark, sf):
    """A batch recipe straight over JSON lines."""
    actions = [
        where("id", "GreaterThanOrEqual", "1000", "Number"), where("customer", "StartsWith", "{object"),
        Rename("id", "order"), Delete("customer"), Fill("facts", "same"),
    ]
    return project(*recipe_over_lines(order_lines(spark, sf), actions))
