"""Literal seed tables for the restaurant and delivery studies (INSERT ... VALUES).

Rows are kept exactly as the seed scripts give them, as text where the seed is
text, and turned into typed tables with `apply_schema`, the way the declared
column types convert them on insert. These fixtures feed tests only; the
registered queries read the driver tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    DateType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

from quarry.sources.tables import apply_schema


def _schema(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


S, I, D, TS = StringType(), IntegerType(), DateType(), TimestampNTZType()

# Declared schemas of the seeded tables.
SCHEMAS = {
    "sales": _schema(("customer_id", S), ("order_date", D), ("product_id", I)),
    "menu": _schema(("product_id", I), ("product_name", S), ("price", I)),
    "members": _schema(("customer_id", S), ("join_date", D)),
    "runners": _schema(("runner_id", I), ("registration_date", D)),
    "customer_orders": _schema(
        ("order_id", I), ("customer_id", I), ("pizza_id", I),
        ("exclusions", S), ("extras", S), ("order_time", TS),
    ),
    "runner_orders": _schema(
        ("order_id", I), ("runner_id", I), ("pickup_time", S),
        ("distance", S), ("duration", S), ("cancellation", S),
    ),
    "pizza_names": _schema(("pizza_id", I), ("pizza_name", S)),
    "pizza_recipes": _schema(("pizza_id", I), ("toppings", S)),
    "pizza_toppings": _schema(("topping_id", I), ("topping_name", S)),
}

# ---- fixed values: seed rows of the restaurant study, as given (text) ----
RESTAURANT_ROWS = {
    "sales": [
        ("A", "2021-01-01", "1"), ("A", "2021-01-01", "2"), ("A", "2021-01-07", "2"),
        ("A", "2021-01-10", "3"), ("A", "2021-01-11", "3"), ("A", "2021-01-11", "3"),
        ("B", "2021-01-01", "2"), ("B", "2021-01-02", "2"), ("B", "2021-01-04", "1"),
        ("B", "2021-01-11", "1"), ("B", "2021-01-16", "3"), ("B", "2021-02-01", "3"),
        ("C", "2021-01-01", "3"), ("C", "2021-01-01", "3"), ("C", "2021-01-07", "3"),
    ],
    "menu": [("1", "sushi", "10"), ("2", "curry", "15"), ("3", "ramen", "12")],
    "members": [("A", "2021-01-07"), ("B", "2021-01-09")],
}

# ---- fixed values: seed rows of the delivery study, as given (text) ----
# None is SQL NULL; '', 'null' and 'NaN' are the text stand-ins of the seed.
DELIVERY_ROWS = {
    "runners": [
        ("1", "2021-01-01"), ("2", "2021-01-03"), ("3", "2021-01-08"), ("4", "2021-01-15"),
    ],
    "customer_orders": [
        ("1", "101", "1", "", "", "2021-01-01 18:05:02"),
        ("2", "101", "1", "", "", "2021-01-01 19:00:52"),
        ("3", "102", "1", "", "", "2021-01-02 23:51:23"),
        ("3", "102", "2", "", "NaN", "2021-01-02 23:51:23"),
        ("4", "103", "1", "4", "", "2021-01-04 13:23:46"),
        ("4", "103", "1", "4", "", "2021-01-04 13:23:46"),
        ("4", "103", "2", "4", "", "2021-01-04 13:23:46"),
        ("5", "104", "1", "null", "1", "2021-01-08 21:00:29"),
        ("6", "101", "2", "null", "null", "2021-01-08 21:03:13"),
        ("7", "105", "2", "null", "1", "2021-01-08 21:20:29"),
        ("8", "102", "1", "null", "null", "2021-01-09 23:54:33"),
        ("9", "103", "1", "4", "1,5", "2021-01-10 11:22:59"),
        ("10", "104", "1", "null", "null", "2021-01-11 18:34:49"),
        ("10", "104", "1", "2,6", "1,4", "2021-01-11 18:34:49"),
    ],
    "runner_orders": [
        ("1", "1", "2021-01-01 18:15:34", "20km", "32 minutes", ""),
        ("2", "1", "2021-01-01 19:10:54", "20km", "27 minutes", ""),
        ("3", "1", "2021-01-03 00:12:37", "13.4km", "20 mins", None),
        ("4", "2", "2021-01-04 13:53:03", "23.4", "40", None),
        ("5", "3", "2021-01-08 21:10:57", "10", "15", None),
        ("6", "3", "null", "null", "null", "Restaurant Cancellation"),
        ("7", "2", "2021-01-08 21:30:45", "25km", "25mins", "null"),
        ("8", "2", "2021-01-10 00:15:02", "23.4 km", "15 minute", "null"),
        ("9", "2", "null", "null", "null", "Customer Cancellation"),
        ("10", "1", "2021-01-11 18:50:20", "10km", "10minutes", "null"),
    ],
    "pizza_names": [("1", "Meatlovers"), ("2", "Vegetarian")],
    "pizza_recipes": [("1", "1, 2, 3, 4, 5, 6, 8, 10"), ("2", "4, 6, 7, 9, 11, 12")],
    "pizza_toppings": [
        ("1", "Bacon"), ("2", "BBQ Sauce"), ("3", "Beef"), ("4", "Cheese"),
        ("5", "Chicken"), ("6", "Mushrooms"), ("7", "Onions"), ("8", "Pepperoni"),
        ("9", "Peppers"), ("10", "Salami"), ("11", "Tomatoes"), ("12", "Tomato Sauce"),
    ],
}


def _typed(spark: SparkSession, name: str, rows: list[tuple]) -> DataFrame:
    schema = SCHEMAS[name]
    text = StructType([StructField(f.name, StringType(), True) for f in schema.fields])
    return apply_schema(spark.createDataFrame(rows, schema=text), schema)


def fixture(spark: SparkSession, name: str) -> DataFrame:
    """One seeded table with its declared schema."""
    rows = RESTAURANT_ROWS.get(name) or DELIVERY_ROWS[name]
    return _typed(spark, name, rows)


def restaurant_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {n: fixture(spark, n) for n in RESTAURANT_ROWS}


def delivery_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {n: fixture(spark, n) for n in DELIVERY_ROWS}
