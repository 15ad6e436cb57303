import datetime as dt

import pytest
from conftest import rows

from quarry.plans import restaurant as R
from quarry.sources.fixtures import restaurant_tables


@pytest.fixture(scope="module")
def t(spark):
    return restaurant_tables(spark)


def d(m, day):
    return dt.date(2021, m, day)


def test_dd1_spend(t):
    assert rows(R.spend(t)) == [("A", 76), ("B", 74), ("C", 36)]


def test_dd2_visit_days(t):
    assert rows(R.visit_days(t)) == [("A", 4), ("B", 6), ("C", 2)]


def test_dd3_first_items_keep_ties(t):
    assert rows(R.first_items(t)) == [("A", "curry"), ("A", "sushi"), ("B", "curry"), ("C", "ramen")]


def test_dd4_most_bought(t):
    assert rows(R.most_bought(t)) == [("ramen", 8)]


def test_dd5_favourites_ties(t):
    got = rows(R.favourites(t), "customer_id", "product_name", "order_count")
    assert got == [("A", "ramen", 3), ("B", "curry", 2), ("B", "ramen", 2), ("B", "sushi", 2), ("C", "ramen", 3)]


def test_dd5_favourites_one_is_deterministic(t):
    got = rows(R.favourites(t, "first"), "customer_id", "product_name")
    assert got == [("A", "ramen"), ("B", "curry"), ("C", "ramen")]


def test_dd6_first_after_joining_includes_join_day(t):
    assert rows(R.first_after_joining(t)) == [("A", d(1, 7), "curry"), ("B", d(1, 11), "sushi")]


def test_dd7_last_before_joining(t):
    assert rows(R.last_before_joining(t)) == [
        ("A", d(1, 1), "curry"), ("A", d(1, 1), "sushi"), ("B", d(1, 4), "sushi")]


def test_dd8_totals_before_joining(t):
    assert rows(R.totals_before_joining(t)) == [("A", 2, 25), ("B", 3, 40)]


def test_dd9_points(t):
    assert rows(R.points(t)) == [("A", 860), ("B", 940), ("C", 360)]


def test_dd10_january_points(t):
    assert rows(R.january_points(t)) == [("A", 1370), ("B", 820)]


def test_dd10_bonus_window_crosses_month(spark, t):
    # join on 31 Jan: the bonus week runs to 6 Feb (a real date, not 31 + 6)
    members = spark.createDataFrame([("B", d(1, 31))], "customer_id string, join_date date")
    t2 = dict(t, members=members)
    got = rows(R.january_points(t2, cutoff=dt.date(2021, 2, 28)))
    # B: before join 01-01 curry 150, 01-02 curry 150, 01-04 sushi 200, 01-11 sushi 200,
    # 01-16 ramen 120; in the window 02-01 ramen 12 x 20 = 240
    assert got == [("B", 150 + 150 + 200 + 200 + 120 + 240)]


def test_declared_schema_casts_text(t):
    s = t["sales"].schema
    assert [f.dataType.simpleString() for f in s.fields] == ["string", "date", "int"]
