"""Recipe actions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.types import ColumnType
from ..plans.apply import apply_recipe
from ..plans.plan import VIEW
from ..recipes import Cast, Delete, Fill, FormatTimestamp, Rename, where
from .registry import query, table


@query("recipe_passthrough", "select * from orders")
def recipe_passthrough(spark, sf):
    return apply_recipe(table(spark, sf, "orders"), [])


@query(
    "recipe_rename_chain",
    "select c_custkey, c_name as customer_name, c_nationkey, c_acctbal as balance, c_mktsegment from customer",
)
def recipe_rename_chain(spark, sf):
    actions = [Rename("c_name", "n1"), Rename("n1", "customer_name"), Rename("c_acctbal", "balance")]
    return apply_recipe(table(spark, sf, "customer"), actions)


@query("recipe_rename_shadow", "select c_custkey, c_nationkey, c_acctbal, c_mktsegment as c_name from customer")
def recipe_rename_shadow(spark, sf):
    return apply_recipe(table(spark, sf, "customer"), [Rename("c_mktsegment", "c_name")])


@query("recipe_delete", "select s_suppkey, s_name from supplier")
def recipe_delete(spark, sf):
    return apply_recipe(table(spark, sf, "supplier"), [Delete("s_acctbal"), Delete("s_nationkey")])


@query(
    "recipe_fill",
    "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, '***' as o_orderpriority from orders",
)
def recipe_fill(spark, sf):
    return apply_recipe(table(spark, sf, "orders"), [Fill("o_orderpriority", "***")])


@query(
    "recipe_last_transform_wins",
    """select o_orderkey, o_custkey, 'second' as o_orderstatus, o_totalprice,
              strftime(o_orderdate, '%Y/%m/%d') as o_orderdate, o_orderpriority from orders""",
)
def recipe_last_transform_wins(spark, sf):
    actions = [
        Fill("o_orderdate", "gone"), FormatTimestamp("o_orderdate", "yyyy/MM/dd"),
        Fill("o_orderstatus", "first"), Fill("o_orderstatus", "second"),
    ]
    return apply_recipe(table(spark, sf, "orders"), actions)


@query(
    "recipe_format_ts",
    """select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') as ts, user_id, event_type, value, props from events""",
)
def recipe_format_ts(spark, sf):
    return apply_recipe(table(spark, sf, "events"), [FormatTimestamp("ts", "yyyy-MM-dd HH:mm:ss.fff")])


@query(
    "recipe_format_ts_text",
    "select o_orderkey, strftime(o_orderdate, '%Y%m%d') as day, strftime(o_orderdate, '%d.%m.%y') as written from orders",
)
def recipe_format_ts_text(spark, sf):
    """Dates that arrive as text, month first and with month names."""
    text = table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "M/d/yyyy").alias("day"),
        F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("written"),
    )
    return apply_recipe(text, [FormatTimestamp("day", "yyyyMMdd"), FormatTimestamp("written", "dd.MM.yy")])


@query("recipe_cast_batch_noop", "select o_orderkey, o_orderpriority from orders")
def recipe_cast_batch_noop(spark, sf):
    frame = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return apply_recipe(frame, [Cast("o_orderpriority", ColumnType.WHOLE)])


@query("recipe_unknown_columns_skipped", "select c_custkey, c_name as name, c_nationkey, c_acctbal, c_mktsegment from customer")
def recipe_unknown_columns_skipped(spark, sf):
    actions = [
        Rename("c_name", "name"), where("c_name", "Equals", "nothing"), Delete("c_name"), Fill("nowhere", "x"),
        FormatTimestamp("c_name", "yyyy"),
    ]
    return apply_recipe(table(spark, sf, "customer"), actions)


CHAINED = [
    where("o_totalprice", "GreaterThan", "100000", "Number"),
    Fill("o_orderpriority", "***"),
    FormatTimestamp("o_orderdate", "yyyy-MM-dd"),
    Rename("o_custkey", "customer"),
]


@query(
    "recipe_chained",
    """select o_orderkey, o_custkey as customer, o_orderstatus, o_totalprice,
              strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, '***' as o_orderpriority
       from orders where o_totalprice > 100000""",
)
def recipe_chained(spark, sf):
    return apply_recipe(table(spark, sf, "orders"), CHAINED)


@query(
    "recipe_lineitem_report",
    """select l_orderkey, l_partkey as part, l_linenumber, l_quantity, l_extendedprice as price, l_discount,
              l_returnflag, strftime(l_shipdate, '%m/%d/%Y') as shipped
       from lineitem where l_quantity >= 25 and l_shipdate < timestamp '1998-01-01' and lower(l_returnflag) <> 'n'""",
)
def recipe_lineitem_report(spark, sf):
    actions = [
        Rename("l_partkey", "part"), Rename("l_extendedprice", "price"), Rename("l_shipdate", "shipped"),
        Delete("l_suppkey"), Delete("l_tax"), Delete("l_linestatus"),
        where("l_quantity", "GreaterThanOrEqual", "25", "Number"),
        where("shipped", "LessThan", "1998-01-01", "Timestamp"),
        where("l_returnflag", "NotEquals", "n"),
        FormatTimestamp("shipped", "MM/dd/yyyy"),
    ]
    return apply_recipe(table(spark, sf, "lineitem"), actions)


@query(
    "view_labels",
    """select cast(c_custkey as varchar) as "c_custkey (number)", c_name as "name (text)",
              regexp_replace(cast(c_acctbal as varchar), '\\.0$', '') as "c_acctbal (float)",
              '7' as "c_mktsegment (number)" from customer""",
)
def view_labels(spark, sf):
    actions = [Rename("c_name", "name"), Delete("c_nationkey"), Fill("c_mktsegment", "7")]
    return apply_recipe(table(spark, sf, "customer"), actions, VIEW, labels=True)
