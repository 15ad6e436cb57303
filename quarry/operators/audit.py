"""Data-quality audits standing in for declared constraints (keys, NOT NULL,
foreign keys, VARCHAR(n)); each returns the offending rows or keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str], out: str = "copies") -> DataFrame:
    """Key values that occur more than once (PRIMARY KEY / UNIQUE), with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out)).filter(F.col(out) > 1)


def null_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with a NULL in any of `cols` (NOT NULL)."""
    cond = None
    for c in cols:
        cond = F.col(c).isNull() if cond is None else (cond | F.col(c).isNull())
    return df.filter(cond)


def orphans(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str | None = None) -> DataFrame:
    """Fact rows whose key has no dimension row (FOREIGN KEY); NULL keys are not orphans."""
    dk = dim_key or fact_key
    keys = dim.select(F.col(dk).alias(fact_key)).distinct() if dk != fact_key else dim.select(dk)
    return fact.filter(F.col(fact_key).isNotNull()).join(keys, fact_key, "left_anti")


def too_long(df: DataFrame, col: str, max_len: int, out: str = "length") -> DataFrame:
    """Rows whose text in `col` exceeds `max_len` characters (VARCHAR(n))."""
    return df.withColumn(out, F.char_length(col)).filter(F.col(out) > max_len)
