"""Reading and writing tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"


def read_table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None, schema: StructType | None = None) -> DataFrame:
    """A Parquet table of a folder; with ``columns`` only those are read."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(f"{folder}/{name}.parquet")
    return df if columns is None else df.select(*columns)


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table; no column is read."""
    return spark.read.parquet(path).count()


def column_names(spark: SparkSession, path: str) -> list[str]:
    """Columns of a Parquet table, from its footers."""
    return spark.read.parquet(path).columns


def write_table(df: DataFrame, path: str, files: int | None = None) -> None:
    """Parquet; ``files`` bounds the number of files, for small tables."""
    (df if files is None else df.coalesce(files)).write.mode("overwrite").parquet(path)


def empty_table(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: the session's checkpoint folder, which is set from spark.checkpoint.dir if need be. Where that is unset too and all runs on this machine, as in tests, one of our own; raises on a cluster."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or "file://" + os.path.join(tempfile.gettempdir(), "checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def materialised(df: DataFrame, *, wide: bool = False) -> DataFrame:
    """df written to the shared folder and read back: later steps start from the files, also after an executor is lost.

    wide: for columns of many deep expressions. In one generated method they pass the 8,000 bytes beyond which the JVM interprets it; with the limit set while the rows are written, Spark splits them.
    """
    spark = df.sparkSession
    shared_folder(spark)
    if not wide:
        return df.checkpoint()
    before = spark.conf.get(HUGE_METHOD)
    spark.conf.set(HUGE_METHOD, "8000")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(HUGE_METHOD, before)


def stored(df: DataFrame) -> DataFrame:
    """As materialised(), but as Parquet, of which later steps read the columns that they need; for long tables that several steps read."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
