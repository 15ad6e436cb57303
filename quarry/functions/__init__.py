"""Column expressions. All are built-in Spark expressions (JVM side, codegen);
none is a Python UDF."""

from quarry.functions.calendar import calendar_part, weekday_name, weekday_number
from quarry.functions.numeric import cents, exact_mean, money, money_total, round_ratio, units_to_decimal
from quarry.functions.text import (
    NULL_TOKENS,
    contains_ci,
    has_many,
    has_token,
    in_ci,
    list_size,
    matches_ci,
    measure,
    money_amount,
    money_currency,
    null_if_token,
    split_list,
    ts_text,
)

__all__ = [
    "NULL_TOKENS", "calendar_part", "cents", "contains_ci", "exact_mean", "has_many",
    "has_token", "in_ci", "list_size", "matches_ci", "measure", "money", "money_amount", "money_total",
    "money_currency", "null_if_token", "round_ratio", "split_list", "ts_text",
    "units_to_decimal", "weekday_name", "weekday_number",
]
