"""Inferred schemas as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.types import ColumnType
from ..operators.drill import infer_leaves, key_path
from ..operators.profile import csv_schema, csv_summary, describe, infer_csv, infer_json, json_schema, json_summary, merge_summaries
from ..sources.csv import read_csv
from .files import csv_of
from .json_cells import order_lines, uneven_lines
from .registry import query, table

_LABELS = ", ".join(f"('{kind.value}', '{kind.label}')" for kind in ColumnType)


@query(
    "schema_csv",
    f"""with t as (
          select 'o_orderkey' as name, case when count(o_orderkey) = count(*) then 'WholeNumber' end as type from orders
          union all select 'o_custkey', 'WholeNumber' from orders
          union all select 'o_orderstatus', case when bool_or(lower(o_orderstatus) in ('true', 'false')) then 'Boolean' else 'Text' end from orders
          union all select 'o_totalprice', case when bool_or(o_totalprice <> floor(o_totalprice)) then 'FloatingPoint' else 'WholeNumber' end from orders
          union all select 'o_orderdate', 'Timestamp' from orders
          union all select 'o_orderpriority', 'Text' from orders)
        select distinct t.name, t.type, l.label, false as nullable from t join (values {_LABELS}) l(type, label) using (type)""",
)
def schema_csv(spark, sf):
    rows = read_csv(spark, csv_of(spark, sf, "orders"), quoted_breaks=False)
    return csv_schema(csv_summary(rows)).drop("first")


@query(
    "schema_csv_nullable",
    """select 'id' as name, 'WholeNumber' as type, 'number' as label, false as nullable
       union all select 'amount', case when max((value <> floor(value))::int) = 1 then 'FloatingPoint' else 'WholeNumber' end, 'float', true from events
       union all select 'flag', 'Boolean', 'bool', true
       union all select 'mixed', 'Text', 'text', false""",
)
def schema_csv_nullable(spark, sf):
    """Empty cells further down make a column nullable and leave its type."""
    later, kind = F.col("event_id") > 0, F.col("event_type")
    rows = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.when(later & (kind == "click"), "").otherwise(F.format_string("%.2f", "value")).alias("amount"),
        F.when(later & (kind == "view"), " ").otherwise(F.when(kind == "error", "TRUE").otherwise("false")).alias("flag"),
        F.when(later & (kind == "signup"), "1.5").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("mixed"),
    )
    return csv_schema(csv_summary(rows, F.col("id"))).drop("first")


@query(
    "schema_csv_first_rows",
    """select * from (values (0, 'p_partkey', 'WholeNumber', 'p_partkey (number)', false), (1, 'p_name', 'Text', 'p_name (text)', false),
         (2, 'p_retailprice', 'FloatingPoint', 'p_retailprice (float)', false)) t(index, name, type, label, nullable)""",
)
def schema_csv_first_rows(spark, sf):
    rows = read_csv(spark, csv_of(spark, sf, "part"), quoted_breaks=False).select("p_partkey", "p_name", "p_retailprice")
    return describe(infer_csv(rows, 200), spark)


@query(
    "schema_jsonl",
    """select * from (values ('id', 'WholeNumber', 'number', false), ('customer', 'JsonObject', 'object', false),
         ('facts', 'JsonArray', 'array', false), ('paid', 'Boolean', 'bool', false)) t(name, type, label, nullable)
       where (select count(*) from orders) > 0""",
)
def schema_jsonl(spark, sf):
    return json_schema(json_summary(order_lines(spark, sf))).drop("first")


@query(
    "schema_jsonl_uneven",
    """select 'leaf' as name, 'Text' as type, 'text' as label, true as nullable from orders group by 1
       union all select 'other', 'WholeNumber', 'number', true from orders where o_orderpriority = '5-LOW' and o_orderstatus = 'F' group by 1""",
)
def schema_jsonl_uneven(spark, sf):
    """Values of all kinds, nulls, absent keys and broken lines."""
    lines = uneven_lines(spark, sf)
    return json_schema(json_summary(lines, F.col("position"))).drop("first")


@query(
    "schema_jsonl_ordered",
    """select * from (values (0, 'id', 'WholeNumber', 'id (number)', false), (1, 'customer', 'JsonObject', 'customer (object)', false),
         (2, 'facts', 'JsonArray', 'facts (array)', false), (3, 'paid', 'Boolean', 'paid (bool)', false)) t(index, name, type, label, nullable)""",
)
def schema_jsonl_ordered(spark, sf):
    return describe(infer_json(order_lines(spark, sf), order=F.col("position")), spark)


@query(
    "schema_drilled",
    """with f as (
         select 'status' as name, 0 as tie, min(o_orderkey) filter (o_orderpriority in ('1-URGENT', '2-HIGH')) as first from orders
         union all select 'value', 1, min(o_orderkey) filter (o_orderpriority = '2-HIGH') from orders
         union all select 'leaf', 2, min(o_orderkey) filter (o_orderpriority in ('3-MEDIUM', '4-NOT SPECIFIED')) from orders)
       select cast(row_number() over (order by first, tie) - 1 as int) as index, name, 'Text' as type, name || ' (text)' as label, true as nullable from f""",
)
def schema_drilled(spark, sf):
    return describe(infer_leaves(uneven_lines(spark, sf), key_path("leaf"), order=F.col("position")), spark)


@query(
    "schema_merged",
    """select 'id' as name, 'WholeNumber' as type, 'number' as label, false as nullable
       union all select 'amount', case when bool_or(o_totalprice <> floor(o_totalprice)) then 'FloatingPoint' else 'WholeNumber' end, 'float', false from orders
       union all select 'note', 'Text', 'text', false""",
)
def schema_merged(spark, sf):
    """Summaries of two stretches of data joined into that of the whole."""
    orders = table(spark, sf, "orders")
    key = F.col("o_orderkey")

    def rows(amount, note):
        return orders.select(key.cast("string").alias("id"), amount.alias("amount"), note.alias("note"), key)

    whole = rows(F.floor("o_totalprice").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    parts = rows(F.format_string("%.2f", "o_totalprice"), F.col("o_custkey").cast("string"))
    summaries = [csv_summary(part.select("id", "amount", "note")) for part in (whole, parts)]
    return csv_schema(merge_summaries(*summaries)).drop("first")
