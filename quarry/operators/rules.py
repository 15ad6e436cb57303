"""Business rules: loyalty points, rule prices, payouts, rates, threshold labels.

All are map-side expressions followed (where a total is asked) by one hash
aggregate with partial aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def case_map(col, mapping: Mapping, otherwise=None) -> Column:
    """CASE col WHEN k THEN v ... [ELSE otherwise]; with no `otherwise` unmatched rows are NULL."""
    c = _c(col)
    expr = None
    for k, v in mapping.items():
        expr = (F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v)))
    if expr is None:
        return F.lit(otherwise)
    return expr.otherwise(F.lit(otherwise)) if otherwise is not None else expr


def points(
    df: DataFrame, key, amount, base: int = 10, item=None,
    multipliers: Mapping | None = None, out: str = "points",
) -> DataFrame:
    """Loyalty points per entity: amount x base, times a per-item multiplier."""
    mult = case_map(item, multipliers, 1) if multipliers else F.lit(1)
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.sum(_c(amount) * F.lit(base) * mult).alias(out))


def points_with_bonus_window(
    df: DataFrame, key, amount, day, anchor_col: str, days: int = 7,
    cutoff: date | None = None, base: int = 10, bonus: int = 2, item=None,
    multipliers: Mapping | None = None, out: str = "points",
) -> DataFrame:
    """Points with a bonus multiplier on everything during the `days` days starting
    on the anchor day (anchor .. anchor + days - 1, inclusive), the per-item
    multiplier elsewhere, counting rows on or before `cutoff` only."""
    d = _c(day)
    rows = df.filter(d <= F.lit(cutoff)) if cutoff is not None else df
    in_window = (d >= F.col(anchor_col)) & (d <= F.date_add(F.col(anchor_col), days - 1))
    item_mult = case_map(item, multipliers, 1) if multipliers else F.lit(1)
    mult = F.when(in_window, F.lit(bonus)).otherwise(item_mult)
    keys = [key] if isinstance(key, str) else list(key)
    return rows.groupBy(*keys).agg(F.sum(_c(amount) * F.lit(base) * mult).alias(out))


def rule_price(col, prices: Mapping) -> Column:
    """Price from a rule table; items without a rule price to NULL (ignored by SUM)."""
    return case_map(col, prices)


def revenue(df: DataFrame, price: Column, surcharge: Column | None = None, out: str = "revenue") -> DataFrame:
    """Total revenue: sum of the rule price plus an optional per-row surcharge."""
    total = F.sum(price)
    if surcharge is not None:
        total = F.coalesce(total, F.lit(0)) + F.coalesce(F.sum(surcharge), F.lit(0))
    return df.agg(total.alias(out))


def net_of_payout(revenue_df: DataFrame, revenue_col: str, payout: DataFrame, payout_col: str, out: str = "net") -> DataFrame:
    """One number: revenue minus payout, each a one-row aggregate (scalar subqueries)."""
    r = revenue_df.select(F.col(revenue_col)).scalar()
    p = payout.select(F.col(payout_col)).scalar()
    return revenue_df.sparkSession.range(1).select((r - p).alias(out))


def rate_units(distance_units, time_units, scale: int = 2, km_per_mile: str | None = "1.609") -> dict[str, Column]:
    """Speed per hour from a distance and a duration in minutes given in the same
    whole units (e.g. both in hundredths), rounded half up to `scale` exactly;
    in miles too when `km_per_mile` is given. Zero duration gives NULL."""
    from decimal import Decimal

    from quarry.functions.numeric import round_ratio, units_to_decimal

    d = _c(distance_units).cast("decimal(38,0)")
    t = _c(time_units).cast("decimal(38,0)")
    up = F.lit(60 * 10**scale)
    res = {"speed_kph": units_to_decimal(round_ratio(d * up, t), scale)}
    if km_per_mile:
        k = Decimal(km_per_mile)
        exp = -k.as_tuple().exponent
        k_int = int(k.scaleb(exp))
        res["speed_mph"] = units_to_decimal(round_ratio(d * up * F.lit(10**exp), t * F.lit(k_int)), scale)
    return res


def rate(distance, minutes, scale: int = 2, km_per_mile: str | None = "1.609") -> dict[str, Column]:
    """Speed per hour from a distance and a duration in minutes, rounded half up
    to `scale`, and the same in miles when `km_per_mile` is given.

    Inputs are DECIMALs with up to 4 decimals; both are taken as whole
    ten-thousandths and the ratio is computed by `rate_units`.
    """
    d = (_c(distance).cast("decimal(38,4)") * F.lit(10**4)).cast("decimal(38,0)")
    t = (_c(minutes).cast("decimal(38,4)") * F.lit(10**4)).cast("decimal(38,0)")
    return rate_units(d, t, scale, km_per_mile)


def bin_by_thresholds(col, bins: Sequence[tuple], default: str) -> Column:
    """Label rows by the first matching range; later ranges only see what earlier
    ones left. Each bin is (label, low, high) with inclusive bounds, or
    (label, low, high, True) for a strict lower bound; None leaves a side open.
    NULL input matches nothing and gets `default` (CASE ... ELSE)."""
    c = _c(col)
    expr = None
    for spec in bins:
        label, lo, hi = spec[:3]
        strict = len(spec) > 3 and spec[3]
        cond = F.lit(True)
        if lo is not None:
            cond = cond & ((c > F.lit(lo)) if strict else (c >= F.lit(lo)))
        if hi is not None:
            cond = cond & (c <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))
