"""Restaurant loyalty study: ten questions over sales, menu and members.

`t` is a dict of DataFrames with the declared schemas (see
`quarry.sources.fixtures.SCHEMAS`); every function returns a DataFrame.
The menu is a dimension; it is joined without a hint so Spark sizes it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import anchor, rank, rules


def _sold(t) -> DataFrame:
    return t["sales"].join(t["menu"], "product_id")


def spend(t) -> DataFrame:
    """DD1: total spent per customer."""
    return _sold(t).groupBy("customer_id").agg(F.sum("price").alias("total_spent"))


def visit_days(t) -> DataFrame:
    """DD2: distinct visit days per customer."""
    return t["sales"].groupBy("customer_id").agg(F.countDistinct("order_date").alias("number_of_days"))


def first_items(t) -> DataFrame:
    """DD3: item(s) of each customer's first visit day, all ties kept."""
    first = rank.first_per(_sold(t), "customer_id", "order_date", ties="all")
    return first.select("customer_id", "product_name").distinct()


def most_bought(t) -> DataFrame:
    """DD4: most bought item and its count (tie: first by name)."""
    counts = _sold(t).groupBy("product_name").agg(F.count("product_id").alias("number_purchased"))
    return rank.top_k(counts, [F.desc("number_purchased")], 1, "first", ["product_name"])


def favourites(t, ties: str = "all") -> DataFrame:
    """DD5: most bought item(s) per customer."""
    return rank.mode_per_group(_sold(t), "customer_id", "product_name", ties, "order_count")


def first_after_joining(t) -> DataFrame:
    """DD6: first purchase(s) on or after the join date."""
    res = anchor.first_on_or_after(_sold(t), t["members"], "customer_id", "order_date", "join_date")
    return res.select("customer_id", "order_date", "product_name")


def last_before_joining(t) -> DataFrame:
    """DD7: last purchase(s) strictly before the join date."""
    res = anchor.last_before(_sold(t), t["members"], "customer_id", "order_date", "join_date")
    return res.select("customer_id", "order_date", "product_name")


def totals_before_joining(t) -> DataFrame:
    """DD8: items and spend before joining."""
    return anchor.totals_before(
        _sold(t), t["members"], "customer_id", "order_date", "join_date",
        "total_items", {"amount_spent": "price"},
    )


def points(t) -> DataFrame:
    """DD9: 10 points per $1, sushi 2x."""
    return rules.points(_sold(t), "customer_id", "price", 10, "product_name", {"sushi": 2}, "member_points")


def january_points(t, cutoff: dt.date = dt.date(2021, 1, 31)) -> DataFrame:
    """DD10: members only; 2x on everything during the first week from the join
    day (inclusive), sushi 2x otherwise; purchases up to the cutoff."""
    days = anchor.per_time(_sold(t), ["customer_id", "order_date", "product_name"], "n", {"price": "price"})
    members = anchor.with_anchor(days, t["members"], "customer_id")
    return rules.points_with_bonus_window(
        members, "customer_id", "price", "order_date", "join_date", 7, cutoff, 10, 2,
        "product_name", {"sushi": 2}, "member_points",
    )


QUESTIONS = {
    "DD1": spend, "DD2": visit_days, "DD3": first_items, "DD4": most_bought, "DD5": favourites,
    "DD6": first_after_joining, "DD7": last_before_joining, "DD8": totals_before_joining,
    "DD9": points, "DD10": january_points,
}
