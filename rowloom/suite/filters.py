"""Every filter operator, on typed columns and on text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.types import ColumnType
from ..plans.apply import apply_recipe, matched_rows
from ..plans.plan import VIEW
from ..recipes import Cast, Fill, FormatTimestamp, Rename, where
from .registry import query, table

_TEXT = {
    "eq": ("Equals", "promo", "lower(p_type) = 'promo'"),
    "neq": ("NotEquals", "Promo", "lower(p_type) <> 'promo'"),
    "contains": ("Contains", "TAND", "contains(lower(p_type), 'tand')"),
    "not_contains": ("NotContains", "o", "not contains(lower(p_type), 'o')"),
    "starts": ("StartsWith", "sma", "starts_with(lower(p_type), 'sma')"),
    "ends": ("EndsWith", "uM", "ends_with(lower(p_type), 'um')"),
}
_ORDER = {"gt": ("GreaterThan", ">"), "lt": ("LessThan", "<"), "ge": ("GreaterThanOrEqual", ">="), "le": ("LessThanOrEqual", "<=")}


def _text_query(operator: str, value: str):
    return lambda spark, sf: apply_recipe(table(spark, sf, "part"), [where("p_type", operator, value)])


def _number_query(operator: str):
    return lambda spark, sf: apply_recipe(table(spark, sf, "lineitem"), [where("l_quantity", operator, "20", "Number")])


def _timestamp_query(operator: str):
    return lambda spark, sf: apply_recipe(table(spark, sf, "events"), [where("ts", operator, "2024-01-15T12:00:00", "Timestamp")])


for _name, (_operator, _value, _condition) in _TEXT.items():
    query(f"filter_text_{_name}", f"select * from part where {_condition}")(_text_query(_operator, _value))
for _name, (_operator, _sign) in _ORDER.items():
    query(f"filter_num_{_name}", f"select * from lineitem where l_quantity {_sign} 20")(_number_query(_operator))
    query(f"filter_ts_{_name}", f"select * from events where ts {_sign} timestamp '2024-01-15 12:00:00'")(_timestamp_query(_operator))


@query("filter_num_decimal_threshold", "select * from part where p_size > 20.5")
def filter_num_decimal_threshold(spark, sf):
    return apply_recipe(table(spark, sf, "part"), [where("p_size", "GreaterThan", "20.5", "Number")])


@query("filter_ts_padded", "select event_id, '  ' || strftime(ts, '%A, %B %-d, %Y %-H:%M:%S') || repeat(' ', 100) as shown from events where date_trunc('second', ts) > timestamp '2024-01-15 12:00:00'")
def filter_ts_padded(spark, sf):
    """Written dates with far more blanks around them than text."""
    shown = F.concat(F.lit("  "), F.date_format("ts", "EEEE, MMMM d, yyyy H:mm:ss"), F.repeat(F.lit(" "), 100))
    rows = table(spark, sf, "events").select("event_id", shown.alias("shown"))
    return apply_recipe(rows, [where("shown", "GreaterThan", "2024-01-15T12:00:00", "Timestamp")])


@query("filter_num_on_text_excludes", "select * from part where false")
def filter_num_on_text_excludes(spark, sf):
    return apply_recipe(table(spark, sf, "part"), [where("p_name", "GreaterThan", "5", "Number")])


@query(
    "filter_num_text_mixed",
    """select o_orderkey, case o_orderstatus when 'F' then printf('%.2f', o_totalprice)
              else cast(cast(floor(o_totalprice) as bigint) as varchar) end as amount
       from orders where o_orderstatus in ('F', 'O')
        and case o_orderstatus when 'F' then round(o_totalprice, 2) else floor(o_totalprice) end >= 250000""",
)
def filter_num_text_mixed(spark, sf):
    """Amounts as text: decimals, integers and words in one column."""
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    amount = (
        F.when(status == "F", F.format_string("%.2f", price))
        .when(status == "O", F.floor(price).cast("string"))
        .otherwise(F.concat(F.lit("n/a "), "o_orderpriority"))
    )
    frame = table(spark, sf, "orders").select("o_orderkey", amount.alias("amount"))
    return apply_recipe(frame, [where("amount", "GreaterThanOrEqual", "250000", "Number")])


@query(
    "filter_num_grouped_digits",
    """select o_orderkey, format('{:,}', cast(floor(o_totalprice) as bigint)) as amount
       from orders where floor(o_totalprice) < 1500.5""",
)
def filter_num_grouped_digits(spark, sf):
    frame = table(spark, sf, "orders").select("o_orderkey", F.format_number(F.floor("o_totalprice"), 0).alias("amount"))
    return apply_recipe(frame, [where("amount", "LessThan", "1,500.5", "Number")])


@query(
    "filter_ts_text",
    """select event_id, strftime(ts, '%-m/%-d/%Y %H:%M') as moment from events
       where date_trunc('minute', ts) >= timestamp '2024-01-20 06:30:00'""",
)
def filter_ts_text(spark, sf):
    frame = table(spark, sf, "events").select("event_id", F.date_format("ts", "M/d/yyyy HH:mm").alias("moment"))
    return apply_recipe(frame, [where("moment", "GreaterThanOrEqual", "2024-01-20 06:30", "Timestamp")])


@query(
    "filter_eq_number_is_text",
    "select * from lineitem where l_quantity = 20",
)
def filter_eq_number_is_text(spark, sf):
    return apply_recipe(table(spark, sf, "lineitem"), [where("l_quantity", "Equals", "20", "Number")])


@query(
    "filter_multi_and",
    """select * from lineitem where l_quantity > 10 and l_discount <= 0.05 and lower(l_returnflag) = 'r'
       and l_shipdate >= timestamp '1997-06-01'""",
)
def filter_multi_and(spark, sf):
    tests = [
        where("l_quantity", "GreaterThan", "10", "Number"), where("l_discount", "LessThanOrEqual", "0.05", "Number"),
        where("l_returnflag", "Equals", "r"), where("l_shipdate", "GreaterThanOrEqual", "6/1/1997", "Timestamp"),
    ]
    return apply_recipe(table(spark, sf, "lineitem"), tests)


@query(
    "filter_after_fill_uses_source",
    """select l_orderkey, l_partkey, l_suppkey, l_linenumber, '0' as l_quantity, l_extendedprice, l_discount, l_tax,
              l_returnflag, l_linestatus, strftime(l_shipdate, '%Y') as l_shipdate
       from lineitem where l_quantity < 5 and l_shipdate > timestamp '1999-01-01'""",
)
def filter_after_fill_uses_source(spark, sf):
    actions = [
        Fill("l_quantity", "0"), FormatTimestamp("l_shipdate", "yyyy"),
        where("l_quantity", "LessThan", "5", "Number"), where("l_shipdate", "GreaterThan", "1999-01-01", "Timestamp"),
    ]
    return apply_recipe(table(spark, sf, "lineitem"), actions)


@query(
    "filter_after_rename",
    """select p_partkey, p_name as product, p_brand, p_type, p_size, p_retailprice from part
       where contains(lower(p_name), 'ring') and lower(p_brand) <> 'brand#7'""",
)
def filter_after_rename(spark, sf):
    actions = [Rename("p_name", "product"), where("product", "Contains", "RING"), where("p_brand", "NotEquals", "brand#7")]
    return apply_recipe(table(spark, sf, "part"), actions)


@query(
    "filter_documents_text",
    "select doc_id, lang, source from documents where contains(lower(text), 'license')",
)
def filter_documents_text(spark, sf):
    """Substring search in whole texts of any length."""
    frame = apply_recipe(table(spark, sf, "documents"), [where("text", "Contains", "License")])
    return frame.select("doc_id", "lang", "source")


@query("matched_rows", "select event_id from events where lower(event_type) = 'error' and value > 50")
def matched(spark, sf):
    tests = [where("event_type", "Equals", "ERROR"), where("value", "GreaterThan", "50", "Number")]
    return matched_rows(table(spark, sf, "events"), tests, "event_id")


# ---------------------------------------------------------------- view filters

@query(
    "view_filter_whole",
    """select cast(p_partkey as varchar) as p_partkey, cast(p_size as varchar) as p_size from part where p_size >= 40""",
)
def view_filter_whole(spark, sf):
    frame = table(spark, sf, "part").select("p_partkey", "p_size")
    return apply_recipe(frame, [where("p_size", "GreaterThanOrEqual", "40", "Number")], VIEW)


@query(
    "view_filter_after_cast",
    """select cast(o_orderkey as varchar) as o_orderkey,
              regexp_replace(printf('%.2f', o_totalprice), '\\.?0+$', '') as amount
       from orders where round(o_totalprice, 2) < 50000""",
)
def view_filter_after_cast(spark, sf):
    """Text compared as numbers only because a cast comes before the filter."""
    frame = table(spark, sf, "orders").select("o_orderkey", F.format_string("%.2f", "o_totalprice").alias("amount"))
    return apply_recipe(frame, [Cast("amount", ColumnType.FLOAT), where("amount", "LessThan", "50000", "Number")], VIEW)


@query("view_filter_text_excludes", "select p_name, p_brand from part where false")
def view_filter_text_excludes(spark, sf):
    frame = table(spark, sf, "part").select("p_name", "p_brand")
    return apply_recipe(frame, [where("p_name", "GreaterThan", "5", "Number")], VIEW)
