"""Helpers on DataFrames shared by the operators: internal names, staged tables, reading."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.words import BLOCK_BYTES
from quarry.session import ensure_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folder of the tables staged inside `scratch`.
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def staging_folder(spark: SparkSession) -> str:
    """This application's folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    return f"{staging_folder(spark)}/{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is staged inside (without a path of its own) is deleted at the end."""
    path = new_path(spark)
    token = _SCRATCH.set(path)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        delete(spark, path)


def staged(df: DataFrame, path: str | None = None) -> DataFrame:
    """The frame written as Parquet to the shared checkpoint folder and read back.

    It cuts lineage, keeps a result that several later steps read, and outlives
    lost executors. `scratch` removes such tables when a step is done, `drop_staged`
    all of the application.
    """
    path = path or f"{_SCRATCH.get() or staging_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of the Arrow batches that tasks hand Python; a block of texts or less.
ARROW_BYTES = BLOCK_BYTES * 3 // 4


def small_batches(spark: SparkSession) -> str:
    """From now on, jobs of the session hand Python batches of about `ARROW_BYTES`; the size before. By
    default a whole split of texts is one batch, held by the JVM and by the worker at the same time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(ARROW_BYTES))
    return before


@contextmanager
def in_small_batches(spark: SparkSession) -> Iterator[None]:
    """`small_batches` for the jobs that run inside."""
    before = small_batches(spark)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def drop_staged(spark: SparkSession) -> None:
    """Delete the staged tables; call it when no result that reads them is needed any more."""
    delete(spark, staging_folder(spark))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of the frame has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
