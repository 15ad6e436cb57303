"""Exact decimal money and rounding.

Prices arrive as DOUBLE. Summing doubles gives results that depend on the order
of addition, which differs run to run on a cluster. Money is therefore summed as
whole cents in DECIMAL (`cents`, `money_total`) and shown as DECIMAL(18,2)
(`money`). Means and ratios are rounded half up from exact whole-number
arithmetic, so no intermediate scale can push a value across a rounding boundary.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
TOTAL = "decimal(38,2)"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def money(col) -> Column:
    """DOUBLE or text amount -> DECIMAL(18,2) (cast rounds half up)."""
    return _c(col).cast(MONEY)


def cents(col, scale: int = 2) -> Column:
    """Amount as a whole number of 10^-scale units (half up), DECIMAL(18,0) so
    sums cannot overflow.

    Computed as sign(x) * floor(|x| * 10^scale + 0.5): exact for DECIMAL input
    (the 0.5 is a DECIMAL literal); for DOUBLE money, whose values carry at most
    `scale` decimals, it equals the half-up DECIMAL conversion and avoids a
    per-row DOUBLE -> DECIMAL cast.
    """
    x = _c(col)
    v = F.floor(F.abs(x) * F.lit(10**scale) + F.lit(Decimal("0.5")))
    return F.when(x < 0, -v).otherwise(v).cast("decimal(18,0)")


def money_total(col, scale: int = 2) -> Column:
    """Aggregate: exact sum of money as DECIMAL(38, scale) (whole units summed,
    scaled once per group)."""
    return units_to_decimal(F.sum(cents(col, scale)), scale)


def round_ratio(num, den) -> Column:
    """Whole-number num / den rounded half away from zero, as DECIMAL(38,0).

    Computed as an exact integral division on DECIMAL(38,0), so sums far beyond
    BIGINT stay exact. NULL when den is 0 or NULL.
    """
    n = _c(num).cast("decimal(38,0)")
    d = _c(den).cast("decimal(38,0)")
    q = _int_div(F.abs(n) * 2 + d, d * 2)
    return F.when(d.isNull() | (d == 0), F.lit(None).cast("decimal(38,0)")).otherwise(
        F.when(n < 0, -q).otherwise(q)
    )


def _int_div(a: Column, b: Column) -> Column:
    """Exact integral division of non-negative whole DECIMALs.

    `pmod` removes the remainder, so the DECIMAL quotient is an exact integer.
    (SQL `div` is not used: on large DECIMALs it returns a BIGINT that can
    overflow, and a BIGINT fast path behind a CASE re-evaluates the operands.)
    """
    return ((a - F.pmod(a, b)) / b).cast("decimal(38,0)")


def units_to_decimal(units, scale: int = 2, precision: int = 38) -> Column:
    """Whole 10^-scale units (BIGINT) -> DECIMAL(precision, scale), exactly."""
    step = F.lit(Decimal(1).scaleb(-scale)).cast(f"decimal({scale + 1},{scale})")
    return (_c(units).cast("decimal(38,0)") * step).cast(f"decimal({precision},{scale})")


def exact_mean(sum_units, count, scale: int = 2) -> Column:
    """Mean of values given as (sum in 10^-scale units, count), rounded half up to `scale`."""
    return units_to_decimal(round_ratio(sum_units, count), scale)
