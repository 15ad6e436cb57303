"""Counting summaries: category pivots, flag splits, calendar counts, rows above
the mean, segment members, entities with a single link."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.calendar import calendar_part, weekday_name


def _keys(key) -> list:
    return [key] if isinstance(key, (str, Column)) else list(key)


def pivot_counts(df: DataFrame, key, col: str, values: Mapping[str, object]) -> DataFrame:
    """One count column per category value: {output column: value}.

    Conditional counts in a single aggregate (no pivot pre-pass to discover
    values); every value gets a column even when it never occurs.
    """
    return df.groupBy(*_keys(key)).agg(
        *[F.count_if(F.col(col) == F.lit(v)).alias(name) for name, v in values.items()]
    )


def flag_split_counts(df: DataFrame, key, flags: Sequence[Column], any_col: str = "with_flags", none_col: str = "without_flags") -> DataFrame:
    """Per entity, rows with at least one flag set and rows with none."""
    anyf = None
    for f in flags:
        anyf = f if anyf is None else (anyf | f)
    anyf = F.coalesce(anyf, F.lit(False))
    return df.groupBy(*_keys(key)).agg(
        F.count_if(anyf).alias(any_col), F.count_if(~anyf).alias(none_col)
    )


def all_flags_count(df: DataFrame, flags: Sequence[Column], out: str = "n") -> DataFrame:
    """Number of rows with every flag set."""
    allf = None
    for f in flags:
        allf = f if allf is None else (allf & f)
    return df.agg(F.count_if(F.coalesce(allf, F.lit(False))).alias(out))


def count_by_calendar(df: DataFrame, ts: str, part: str, out: str = "n") -> DataFrame:
    """Row counts by hour, weekday, month or year of `ts`. Weekday gives both the
    full day name and its number (Sunday = 1) so results sort Sunday..Saturday."""
    if part == "weekday":
        return df.groupBy(
            weekday_name(ts).alias("weekday_name"), calendar_part(ts, "weekday").alias("weekday_number")
        ).agg(F.count(F.lit(1)).alias(out))
    return df.groupBy(calendar_part(ts, part).alias(part)).agg(F.count(F.lit(1)).alias(out))


def above_average(df: DataFrame, col: str) -> DataFrame:
    """Rows whose `col` is strictly above the table mean.

    Compared exactly as col * count > sum. Count and sum come from one
    uncorrelated scalar subquery returning both (a global aggregate with
    partial aggregation), evaluated before the filter scan.
    """
    stats = df.agg(F.struct(F.count(col).alias("n"), F.sum(col).alias("s")).alias("st")).scalar()
    return df.filter(F.col(col) * stats.getField("n") > stats.getField("s"))


def segment_members(df: DataFrame, predicate: Column, cols: Sequence[str]) -> DataFrame:
    """Distinct members (projected to `cols`) of the rows matching `predicate`."""
    return df.filter(predicate).select(*cols).distinct()


def segment_count(df: DataFrame, predicate: Column, key: str, out: str = "members") -> DataFrame:
    """Number of distinct keys among the rows matching `predicate`."""
    return df.filter(predicate).agg(F.countDistinct(key).alias(out))


def singletons(bridge: DataFrame, key: str, out: str = "n_single") -> DataFrame:
    """Number of keys that occur exactly once in a link table (aggregate of an aggregate)."""
    per_key = bridge.groupBy(key).agg(F.count(F.lit(1)).alias("_links"))
    return per_key.agg(F.count_if(F.col("_links") == 1).alias(out))


def count_distinct_whole(df: DataFrame, key: str, out: str = "n") -> DataFrame:
    """One row: the exact number of distinct values of a whole-number column (NULL is none).

    64 neighbouring values share a word of flags; words are combined with `bit_or` before
    and after the shuffle and their flags counted. What moves is one row for each word in use
    and task: for densely numbered keys a 64th of the keys, and never more than them.
    """
    flag = F.expr("shiftleft(1L, cast(pmod(_value, 64) AS int))")
    words = df.select(F.col(key).cast("bigint").alias("_value")).filter("_value is not null")
    words = words.groupBy(F.shiftright("_value", 6).alias("_word")).agg(F.bit_or(flag).alias("_flags"))
    return words.agg(F.coalesce(F.sum(F.bit_count("_flags")), F.lit(0)).cast("bigint").alias(out))
