"""Small helpers that the corpus operators share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset and all runs on this machine, a temporary one. Raises on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return found.rstrip("/")


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is in."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back, so a lost executor costs no recomputation of what came before."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


#: Bounds of what met() broadcasts: keys in all, and the share of all rows that makes a key common.
BROADCAST_KEYS, COMMON_SHARE = 100_000, 0.001


def met(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """rows joined with found (key, n, ...); n: about how many rows have each key.

    Up to BROADCAST_KEYS keys are broadcast. Of more, those that COMMON_SHARE of the rows have are, as each would land in one task, and there
    are at most 1 / COMMON_SHARE of them; the others are joined by a shuffle.
    """
    n_keys, total = found.agg(F.count("*"), F.sum("n")).first()
    if n_keys <= BROADCAST_KEYS:
        return rows.join(F.broadcast(found), key)
    hot = F.broadcast(found.where(F.col("n") >= total * COMMON_SHARE))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(found.where(F.col("n") < total * COMMON_SHARE), key))


def clean_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def code_points(text):
    """Length in code points, with null as empty."""
    return F.length(F.coalesce(text, F.lit("")))
