"""Joins of facts to dimensions.

No join here carries a broadcast hint: the static `autoBroadcastJoinThreshold` check
on plan statistics and AQE's check on the real shuffle size choose broadcast or
sort-merge at run time, and AQE splits skewed partitions. Only sides that a
`limit(k)` bounds by construction are broadcast, where they are made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def join_dim(fact: DataFrame, dim: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join `fact` to dimension `dim`; Spark decides how from the sizes."""
    return fact.join(dim, on, how)


def semi_join(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of `df` whose key occurs in `keys` (IN subquery); never duplicates rows."""
    return df.join(keys, on, "left_semi")


def anti_join(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of `df` whose key does not occur in `keys` (NOT IN / orphan check)."""
    return df.join(keys, on, "left_anti")
