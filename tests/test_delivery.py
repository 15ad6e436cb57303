# The answers of the delivery questions on their own tables, as printed with them.
import datetime as dt
from decimal import Decimal as D

import pytest
from conftest import rows

from quarry.plans import delivery as P
from quarry.sources.fixtures import delivery_tables


@pytest.fixture(scope="module")
def t(spark):
    return delivery_tables(spark)


def test_pr1_stand_ins_become_null(t):
    got = rows(P.clean_orders(t), "order_id", "pizza_id", "exclusions", "extras")
    assert got[3] == (3, 2, None, None)          # '' and 'NaN'
    assert (10, 1, "2,6", "1,4") in got
    assert all(x not in ("", "null", "NaN") for r in got for x in r[2:])


def test_pr2_measures_and_timestamps(t):
    got = {r.order_id: r for r in P.clean_deliveries(t).collect()}
    assert got[1].distance == D("20.00") and got[1].duration == D("32.00")
    assert got[8].distance == D("23.40") and got[8].duration == D("15.00")
    assert got[6].distance is None and got[6].pickup_time is None
    assert got[3].pickup_time == dt.datetime(2021, 1, 3, 0, 12, 37)
    assert got[1].cancellation is None and got[7].cancellation is None
    assert got[9].cancellation == "Customer Cancellation"


def test_pa1_pa2(t):
    assert rows(P.lines_ordered(t)) == [(14,)]
    assert rows(P.distinct_orders(t)) == [(10,)]


def test_pa3_completed_per_runner(t):
    assert rows(P.completed_per_runner(t)) == [(1, 4), (2, 3), (3, 1)]


def test_pa4_delivered_per_type(t):
    assert rows(P.delivered_per_type(t)) == [("Meatlovers", 9), ("Vegetarian", 3)]


def test_pa5_pivot(t):
    assert rows(P.type_counts_per_customer(t)) == [
        (101, 2, 1), (102, 2, 1), (103, 3, 1), (104, 3, 0), (105, 0, 1)]


def test_pa6_largest_order(t):
    assert rows(P.largest_delivered_order(t)) == [(3,)]


def test_pa7_changes(t):
    assert rows(P.changed_per_customer(t)) == [
        (101, 0, 2), (102, 0, 3), (103, 3, 0), (104, 2, 1), (105, 1, 0)]


def test_pa8_both(t):
    assert rows(P.both_changes(t)) == [(1,)]


def test_pa9_hour(t):
    assert rows(P.volume_by_hour(t)) == [(11, 1), (13, 3), (18, 3), (19, 1), (21, 3), (23, 3)]


def test_pa10_weekday(t):
    got = rows(P.volume_by_weekday(t), "weekday_number", "weekday_name", "number_of_pizzas")
    assert got == [(1, "Sunday", 1), (2, "Monday", 5), (6, "Friday", 5), (7, "Saturday", 3)]


def test_pb1_order_grain_matches_printed(t):
    assert rows(P.mean_distance_per_customer(t)) == [
        (101, D("20.00")), (102, D("18.40")), (103, D("23.40")), (104, D("10.00")), (105, D("25.00"))]


def test_pb1_line_grain(t):
    got = dict(rows(P.mean_distance_per_customer(t, "line")))
    assert got[102] == D("16.73")


def test_pb2_both_grains(t):
    assert rows(P.mean_distance_per_runner(t)) == [(1, D("15.85")), (2, D("23.93")), (3, D("10.00"))]
    assert rows(P.mean_distance_per_runner(t, "line")) == [(1, D("14.47")), (2, D("23.72")), (3, D("10.00"))]


def test_pb3_speed(t):
    got = rows(P.speed_per_delivery(t), "order_id", "avg_speed_kph", "avg_speed_mph")
    assert got == [
        (1, D("37.50"), D("23.31")), (2, D("44.44"), D("27.62")), (3, D("40.20"), D("24.98")),
        (4, D("35.10"), D("21.81")), (5, D("40.00"), D("24.86")), (7, D("60.00"), D("37.29")),
        (8, D("93.60"), D("58.17")), (10, D("60.00"), D("37.29"))]


def test_pc0_unnest(t):
    got = rows(P.recipe_toppings(t), "pizza_id", "single_topping")
    assert len(got) == 14 and got[:3] == [(1, 1), (1, 2), (1, 3)]


def test_pc1_ingredients(t):
    assert rows(P.standard_ingredients(t)) == [
        ("Meatlovers", "Bacon, BBQ Sauce, Beef, Cheese, Chicken, Mushrooms, Pepperoni, Salami"),
        ("Vegetarian", "Cheese, Mushrooms, Onions, Peppers, Tomatoes, Tomato Sauce")]


def test_pc2_pc3(t):
    assert rows(P.most_common_extra(t)) == [("Bacon", 4)]
    assert rows(P.most_common_exclusion(t)) == [("Cheese", 4)]


def test_pd_revenue(t):
    assert rows(P.revenue_all_orders(t)) == [(160,)]
    assert rows(P.revenue_with_extras(t)) == [(142,)]
    assert rows(P.revenue_less_payout(t)) == [(D("94.44"),)]


def test_px1_supreme(t):
    got = rows(P.add_supreme(t))
    assert len(got) == 3 and got[2] == (3, "Supreme", "1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12")


def test_cleaned_tables_serve_plain_sql(spark, t):
    """Staged as views, the cleaned tables answer SQL written against them."""
    from quarry.sources import stage_all

    stage_all({"orders_clean": P.clean_orders(t), "deliveries_clean": P.clean_deliveries(t)})
    got = rows(spark.sql("""
        SELECT runner_id, COUNT(order_id) AS successful_orders FROM deliveries_clean
        WHERE cancellation IS NULL GROUP BY runner_id"""))
    assert got == rows(P.completed_per_runner(t))


def test_extras_counted_once_for_an_order_with_two_types(spark, t):
    """S11: an order with two pizza types and extras on one of them. Summing extras
    at pizza-line grain counts the 2 extras once (a per-(order, type) grouping
    that joins order-level extras would count them twice)."""
    from quarry.sources import append_rows

    co = append_rows(t["customer_orders"], [(11, 106, 1, None, "1, 4", dt.datetime(2021, 1, 12, 12, 0, 0)),
                                            (11, 106, 2, None, None, dt.datetime(2021, 1, 12, 12, 0, 0))])
    ro = append_rows(t["runner_orders"], [(11, 3, "2021-01-12 12:20:00", "5km", "10 mins", None)])
    t2 = dict(t, customer_orders=co, runner_orders=ro)
    assert rows(P.revenue_with_extras(t2)) == [(142 + 12 + 10 + 2,)]
