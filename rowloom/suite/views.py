"""View-mode casts: text shown by type, with a marker where it cannot be read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.parsing import text_type_code
from ..functions.types import ColumnType
from ..plans.apply import apply_recipe
from ..plans.plan import VIEW
from ..recipes import Cast, FormatTimestamp
from .registry import query, table


def _mixed_orders(spark, sf):
    """One text column that holds integers, decimals, words and dates in turn."""
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    text = (
        F.when(priority == "1-URGENT", F.concat(F.lit(" 00"), F.col("o_custkey").cast("string"), F.lit(" ")))
        .when(priority == "2-HIGH", F.col("o_totalprice").cast("string"))
        .when(priority == "3-MEDIUM", F.when(F.col("o_orderstatus") == "F", "True").otherwise("no"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    )
    return table(spark, sf, "orders").select(key.cast("string").alias("id"), text.alias("mixed"))


_SQL = """with m as (select o_orderkey k, o_custkey c, o_totalprice p, o_orderstatus s, o_orderdate d, o_orderpriority[1] g from orders)
select cast(k as varchar) as id, {shown} as mixed from m"""


def _cast(target: ColumnType):
    return lambda spark, sf: apply_recipe(_mixed_orders(spark, sf), [Cast("mixed", target)], VIEW)


query("view_cast_whole", _SQL.format(shown="case when g = '1' then cast(c as varchar) else '<invalid>' end"))(_cast(ColumnType.WHOLE))
query(
    "view_cast_float",
    _SQL.format(shown="""case when g = '1' then cast(c as varchar)
        when g = '2' then regexp_replace(cast(p as varchar), '\\.0$', '') else '<invalid>' end"""),
)(_cast(ColumnType.FLOAT))
query("view_cast_bool", _SQL.format(shown="case when g = '3' and s = 'F' then 'true' else '<invalid>' end"))(_cast(ColumnType.BOOLEAN))
query("view_cast_ts", _SQL.format(shown="case when g > '3' then strftime(d, '%Y-%m-%d %H:%M:%S') else '<invalid>' end"))(_cast(ColumnType.TIMESTAMP))
query(
    "view_cast_text",
    _SQL.format(shown="""case when g = '1' then ' 00' || c || ' ' when g = '2' then cast(p as varchar)
        when g = '3' then case when s = 'F' then 'True' else 'no' end else strftime(d, '%Y-%m-%dT%H:%M:%S') end"""),
)(_cast(ColumnType.TEXT))


@query("view_format_ts", _SQL.format(shown="case when g > '3' then strftime(d, '%d %B %Y') else '<invalid>' end"))
def view_format_ts(spark, sf):
    actions = [Cast("mixed", ColumnType.TIMESTAMP), FormatTimestamp("mixed", "dd MMMM yyyy")]
    return apply_recipe(_mixed_orders(spark, sf), actions, VIEW)


@query(
    "view_cast_typed",
    """select o_orderkey as id, case when o_orderpriority = '1-URGENT' then cast(o_custkey as double)
              when o_orderpriority = '2-HIGH' then o_totalprice end as mixed from orders""",
)
def view_cast_typed(spark, sf):
    actions = [Cast("id", ColumnType.WHOLE), Cast("mixed", ColumnType.FLOAT)]
    return apply_recipe(_mixed_orders(spark, sf), actions, VIEW, typed=True)


@query(
    "cell_types",
    """select case o_orderpriority[1] when '1' then 'WholeNumber' when '2' then 'FloatingPoint'
              when '3' then case when o_orderstatus = 'F' then 'Boolean' else 'Text' end else 'Timestamp' end as type,
              count(*) as cells from orders group by 1""",
)
def cell_types(spark, sf):
    """How many cells of a column read as each type."""
    named = None
    for kind in ColumnType:
        test = F.col("code") == kind.code
        named = F.when(test, kind.value) if named is None else named.when(test, kind.value)
    coded = _mixed_orders(spark, sf).select(text_type_code(F.col("mixed")).alias("code"))
    return coded.groupBy(named.alias("type")).agg(F.count(F.lit(1)).alias("cells"))
