"""Column profiles in one scan: null counts, min/max, table row counts.

The `footer` variants read no column data: Spark's Parquet reader (version 2) answers
counts, minima and maxima from the statistics in the file footers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def null_profile(df: DataFrame, cols: Sequence[str] | None = None, suffix: str = "_nulls") -> DataFrame:
    """One row: the number of NULLs in each column, all from a single scan."""
    names = list(cols) if cols else df.columns
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}{suffix}") for c in names])


def min_max_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: min_<c> and max_<c> for each column, one scan."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return df.agg(*aggs)


def row_counts(tables: Mapping[str, DataFrame], name_col: str = "table_name", out: str = "row_count") -> DataFrame:
    """One row per table with its row count; the counts run as one job (a union
    of global aggregates, each reading only parquet metadata-sized columns)."""
    parts = [
        df.agg(F.count(F.lit(1)).alias(out)).select(F.lit(name).alias(name_col), out)
        for name, df in tables.items()
    ]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


def _footer_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose Parquet reader pushes aggregates down."""
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session


def row_counts_from_footers(
    spark: SparkSession, paths: Mapping[str, str], name_col: str = "table_name", out: str = "row_count"
) -> DataFrame:
    """`row_counts` of Parquet tables, given by path, from their footers alone."""
    session = _footer_session(spark)
    return row_counts({name: session.read.parquet(path) for name, path in paths.items()}, name_col, out)


#: Types whose footer statistics always equal MIN and MAX. Fractions are not among them (footers
#: leave NaN out, MAX does not), nor text (statistics may be cut short) and timestamps (not pushed).
FOOTER_TYPES = ("tinyint", "smallint", "int", "bigint")


def footer_profile(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    """One row per column of a Parquet table, from the footers alone: column_name, rows, values
    (not NULL), min_value and max_value. The columns are whole numbers, see FOOTER_TYPES."""
    df = _footer_session(spark).read.parquet(path)
    types = dict(df.dtypes)
    for c in cols:
        if types[c] not in FOOTER_TYPES:
            raise ValueError(f"{c} is {types[c]}: the footers may not give its MIN and MAX")
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"_n{i}"), F.min(c).alias(f"_low{i}"), F.max(c).alias(f"_high{i}")]
    rows = [
        F.struct(
            F.lit(c).alias("column_name"), F.col("_rows").alias("rows"), F.col(f"_n{i}").alias("values"),
            F.col(f"_low{i}").cast("bigint").alias("min_value"), F.col(f"_high{i}").cast("bigint").alias("max_value"),
        )
        for i, c in enumerate(cols)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))
