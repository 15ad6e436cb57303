"""Reading and writing tables.

`load` returns lazy DataFrames: nothing is read until an action, and Catalyst
prunes columns and pushes filters into each parquet scan of the final plan.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(base_dir: str, name: str) -> str:
    return os.path.join(base_dir, f"{name}.parquet")


def table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """One table stored as `<base_dir>/<name>.parquet` (file or folder), as it is now."""
    return spark.read.parquet(table_path(base_dir, name))


def load(
    spark: SparkSession, base_dir: str, names: Iterable[str] | None = None
) -> dict[str, DataFrame]:
    """Lazy scans of several tables, keyed by table name."""
    return {n: table(spark, base_dir, n) for n in (names or DRIVER_TABLES)}


def read_text_table(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "csv", **options
) -> DataFrame:
    """A table exported as text (CSV by default) read with a declared schema.

    Every column is read as text first and converted with `apply_schema`, so a
    value that does not fit its declared type becomes NULL instead of failing
    the job or silently shifting columns; no schema inference pass is made.
    """
    from pyspark.sql.types import StringType, StructField

    text = StructType([StructField(f.name, StringType(), True) for f in schema.fields])
    opts = {"header": "true", "mode": "PERMISSIVE"}
    opts.update(options)
    return apply_schema(spark.read.format(fmt).schema(text).options(**opts).load(path), schema)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Name an intermediate result for SQL (CREATE TEMPORARY TABLE ... AS):
    registers a temp view and returns the DataFrame; nothing is materialised."""
    df.createOrReplaceTempView(name)
    return df


def stage_all(tables: dict[str, DataFrame], prefix: str = "") -> dict[str, DataFrame]:
    """Register every table of a study as a temp view (`prefix` + name), so
    existing SQL can run on Spark SQL against the same tables."""
    for name, df in tables.items():
        stage(df, f"{prefix}{name}")
    return tables


def apply_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """Give `df` a declared schema: select the declared columns in order and
    convert each with `try_cast`, so text that does not fit becomes NULL
    instead of failing the job (ANSI `cast` would raise)."""
    cols = []
    for field in schema.fields:
        c = F.col(field.name)
        if df.schema[field.name].dataType != field.dataType:
            c = c.try_cast(field.dataType)
        cols.append(c.alias(field.name))
    return df.select(*cols)


def save(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    """Persist a result as parquet. `overwrite` removes what was there before it writes:
    use `replace` where the query reads the old table, or the old rows must outlive a failure."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def replace(df: DataFrame, path: str, partition_by=None) -> DataFrame:
    """Replace the parquet table at `path` by a query's result (CREATE TABLE AS over an
    existing name), and return the new table.

    The result is written beside the old table first, so the query may read the table
    that it replaces, and a write that fails leaves the old rows as they were. Only a
    whole result is switched in: the old folder is renamed away, the new one takes its
    name, and the old one is deleted; if the switch fails, the old one is renamed back.
    DataFrames made from the old table must not be used afterwards. On an object store,
    where renaming is copying, name tables in a catalog and switch there instead.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    names = (path, f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}")
    target, fresh, old = (jvm.org.apache.hadoop.fs.Path(p) for p in names)
    files = target.getFileSystem(conf)
    try:
        save(df, names[1], "errorifexists", partition_by)
    except BaseException:
        files.delete(fresh, True)
        raise
    had = files.exists(target)
    if had and not files.rename(target, old):
        files.delete(fresh, True)
        raise OSError(f"{path} could not be renamed")
    if not files.rename(fresh, target):
        if had:
            files.rename(old, target)
        raise OSError(f"{path} could not be replaced; the new rows are in {names[1]}")
    if had:
        files.delete(old, True)
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)


def save_bucketed(
    df: DataFrame, table_name: str, keys: list[str], buckets: int, mode: str = "overwrite"
) -> DataFrame:
    """Write `df` as a catalog table bucketed (and sorted) on `keys`.

    Two tables bucketed on their join key with the same bucket count join
    without a shuffle on either side, so a one-time layout of the largest
    tables (e.g. lineitem and orders on the order key) removes the exchange
    from every later join of the pair. Returns the saved table.
    """
    df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table_name)
    return df.sparkSession.table(table_name)


def append_rows(df: DataFrame, rows: list[tuple]) -> DataFrame:
    """`df` plus literal rows given in `df`'s column order (INSERT ... VALUES)."""
    extra = df.sparkSession.createDataFrame(rows, schema=df.schema)
    return df.unionByName(extra)
