"""Food-delivery study: cleaning dirty order tables, then 21 questions.

`t` holds the raw seeded tables (text stand-ins, units in measures, timestamps
as text); `clean_orders` and `clean_deliveries` turn them into typed tables,
and every question runs on the cleaned pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import cents, exact_mean, measure, null_if_token, split_list, ts_text
from quarry.operators import lists, rules, summary
from quarry.sources import append_rows

# ---- fixed values: prices of the study's pricing questions ----
PIZZA_PRICES = {1: 12, 2: 10}
EXTRA_CHARGE = 1
PAY_PER_KM = "0.30"


def clean_orders(t) -> DataFrame:
    """PR1: exclusions/extras with every stand-in ('', 'null', 'NaN') as NULL."""
    co = t["customer_orders"]
    return co.select(
        "order_id", "customer_id", "pizza_id",
        null_if_token("exclusions").alias("exclusions"), null_if_token("extras").alias("extras"),
        "order_time",
    )


def clean_deliveries(t) -> DataFrame:
    """PR2: pickup time as a timestamp, distance and duration as DECIMAL(10,2)
    with units stripped, cancellation stand-ins as NULL."""
    ro = t["runner_orders"]
    return ro.select(
        "order_id", "runner_id", ts_text("pickup_time").alias("pickup_time"),
        measure("distance").alias("distance"), measure("duration").alias("duration"),
        null_if_token("cancellation").alias("cancellation"),
    )


def _delivered_lines(t) -> DataFrame:
    ro = clean_deliveries(t).filter(F.col("cancellation").isNull())
    return clean_orders(t).join(ro, "order_id")


def lines_ordered(t) -> DataFrame:
    """PA1."""
    return clean_orders(t).agg(F.count(F.lit(1)).alias("pizzas_ordered"))


def distinct_orders(t) -> DataFrame:
    """PA2."""
    return clean_orders(t).agg(F.countDistinct("order_id").alias("unique_orders"))


def completed_per_runner(t) -> DataFrame:
    """PA3."""
    ro = clean_deliveries(t).filter(F.col("cancellation").isNull())
    return ro.groupBy("runner_id").agg(F.count("order_id").alias("successful_orders"))


def delivered_per_type(t) -> DataFrame:
    """PA4."""
    lines = _delivered_lines(t).join(t["pizza_names"], "pizza_id")
    return lines.groupBy("pizza_name").agg(F.count("pizza_name").alias("delivery_count"))


def type_counts_per_customer(t) -> DataFrame:
    """PA5."""
    return summary.pivot_counts(clean_orders(t), "customer_id", "pizza_id", {"meat_lovers": 1, "vegetarian": 2})


def largest_delivered_order(t) -> DataFrame:
    """PA6."""
    per_order = _delivered_lines(t).groupBy("order_id").agg(F.count("pizza_id").alias("n"))
    return per_order.agg(F.max("n").alias("max_delivered_pizzas"))


def _changes():
    return [F.col("exclusions").isNotNull(), F.col("extras").isNotNull()]


def changed_per_customer(t) -> DataFrame:
    """PA7."""
    return summary.flag_split_counts(_delivered_lines(t), "customer_id", _changes(), "with_changes", "without_changes")


def both_changes(t) -> DataFrame:
    """PA8."""
    return summary.all_flags_count(_delivered_lines(t), _changes(), "number_of_pizzas")


def volume_by_hour(t) -> DataFrame:
    """PA9."""
    return summary.count_by_calendar(clean_orders(t), "order_time", "hour", "number_of_pizzas")


def volume_by_weekday(t) -> DataFrame:
    """PA10."""
    return summary.count_by_calendar(clean_orders(t), "order_time", "weekday", "number_of_pizzas")


def _mean_distance(t, key: str, grain: str) -> DataFrame:
    """Mean distance per `key` over delivered orders.

    grain="order": each delivery once (one row per order);
    grain="line": once per pizza, the grain of joining deliveries to order lines.
    """
    ro = clean_deliveries(t).filter(F.col("pickup_time").isNotNull())
    co = clean_orders(t)
    if grain == "order":
        who = co.select("order_id", "customer_id").distinct()
    else:
        who = co.select("order_id", "customer_id")
    rows = who.join(ro, "order_id")
    agg = rows.groupBy(key).agg(F.sum(cents("distance")).alias("_s"), F.count("distance").alias("_n"))
    return agg.select(key, exact_mean("_s", "_n").alias("distance"))


def mean_distance_per_customer(t, grain: str = "order") -> DataFrame:
    """PB1."""
    return _mean_distance(t, "customer_id", grain)


def mean_distance_per_runner(t, grain: str = "order") -> DataFrame:
    """PB2."""
    return _mean_distance(t, "runner_id", grain)


def speed_per_delivery(t) -> DataFrame:
    """PB3: per delivered order, pizzas, distance, duration and speed in km/h and mph."""
    pizzas = clean_orders(t).groupBy("customer_id", "order_id").agg(F.count("pizza_id").alias("n_pizzas"))
    ro = clean_deliveries(t).filter(F.col("pickup_time").isNotNull())
    rows = ro.join(pizzas, "order_id")
    sp = rules.rate("distance", "duration")
    return rows.select(
        "customer_id", "order_id", "runner_id", "n_pizzas", "distance", "duration",
        sp["speed_kph"].alias("avg_speed_kph"), sp["speed_mph"].alias("avg_speed_mph"),
    )


def recipe_toppings(t) -> DataFrame:
    """PC0: one row per (pizza, topping id) of the recipes."""
    rec = t["pizza_recipes"].join(t["pizza_names"], "pizza_id")
    return lists.explode_list(rec, "toppings", ",", "int", out="single_topping", keep=["pizza_id", "pizza_name"])


def standard_ingredients(t) -> DataFrame:
    """PC1: topping names of each recipe, in topping-id order."""
    decoded = lists.decode_list(
        t["pizza_recipes"], "pizza_id", "toppings", t["pizza_toppings"], "topping_id", "topping_name",
        out="toppings",
    )
    return decoded.join(t["pizza_names"], "pizza_id").select("pizza_name", "toppings")


def _top_topping(t, col: str, k: int = 1) -> DataFrame:
    counts = lists.token_frequency(clean_orders(t), col, ",", "int", token="topping_id", count_col="uses")
    named = counts.join(t["pizza_toppings"], "topping_id")
    from quarry.operators.rank import top_k

    return top_k(named, [F.desc("uses")], k, "first", ["topping_id"]).select("topping_name", "uses")


def most_common_extra(t) -> DataFrame:
    """PC2."""
    return _top_topping(t, "extras")


def most_common_exclusion(t) -> DataFrame:
    """PC3."""
    return _top_topping(t, "exclusions")


def _price():
    return rules.rule_price("pizza_id", PIZZA_PRICES)


def revenue_all_orders(t) -> DataFrame:
    """PD1: revenue of every ordered pizza, cancellations included."""
    return rules.revenue(clean_orders(t), _price(), out="pizza_revenue_before_cancellation")


def revenue_with_extras(t) -> DataFrame:
    """PD2: delivered pizzas at rule prices plus a charge per extra, summed per line."""
    extras = F.coalesce(F.size(split_list("extras", ",", "int")), F.lit(0)) * F.lit(EXTRA_CHARGE)
    return rules.revenue(_delivered_lines(t), _price(), extras, out="total_income")


def revenue_less_payout(t) -> DataFrame:
    """PD3: delivered revenue minus the per-km runner pay."""
    rev = rules.revenue(_delivered_lines(t), _price(), out="revenue")
    ro = clean_deliveries(t).filter(F.col("pickup_time").isNotNull())
    pay = ro.agg(F.sum(F.col("distance") * F.lit(PAY_PER_KM).cast("decimal(3,2)")).alias("payout"))
    res = rules.net_of_payout(rev, "revenue", pay, "payout", "total_revenue")
    return res.select(F.round("total_revenue", 2).alias("total_revenue"))


def add_supreme(t) -> DataFrame:
    """PX1: a new pizza with every topping, appended to names and recipes, then joined."""
    names = append_rows(t["pizza_names"], [(3, "Supreme")])
    all_toppings = ", ".join(str(i) for i in range(1, 13))
    recipes = append_rows(t["pizza_recipes"], [(3, all_toppings)])
    return names.join(recipes, "pizza_id").select("pizza_id", "pizza_name", "toppings")


QUESTIONS = {
    "PR1": clean_orders, "PR2": clean_deliveries, "PA1": lines_ordered, "PA2": distinct_orders,
    "PA3": completed_per_runner, "PA4": delivered_per_type, "PA5": type_counts_per_customer,
    "PA6": largest_delivered_order, "PA7": changed_per_customer, "PA8": both_changes,
    "PA9": volume_by_hour, "PA10": volume_by_weekday, "PB1": mean_distance_per_customer,
    "PB2": mean_distance_per_runner, "PB3": speed_per_delivery, "PC0": recipe_toppings,
    "PC1": standard_ingredients, "PC2": most_common_extra, "PC3": most_common_exclusion,
    "PD1": revenue_all_orders, "PD2": revenue_with_extras, "PD3": revenue_less_payout,
    "PX1": add_supreme,
}
