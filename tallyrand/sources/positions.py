"""The order in which rows stand in a table's files, for stable ranks and first rows as an input order gives them.

A row's position is its file and its row there. Files come in the order of their paths, which is that of a table's parts as Spark writes them, up to 100,000 of them (their numbers have five digits).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import ranked


def placed(spark: SparkSession, path: str, columns: Sequence[str] | None = None, name: str = "position") -> DataFrame:
    """A Parquet table with ``name``: a struct (file, row) that grows along the files; only ``columns`` are read.

    Nothing is shuffled or counted, so it costs no more than the scan; raises where the table has a column of that name.
    """
    df = spark.read.parquet(path)
    wanted = list(df.columns if columns is None else columns)
    if name in wanted:
        raise ValueError(f"the table has a column {name}")
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return df.select(*(F.col(f"`{c}`") for c in wanted), at.alias(name))


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, n): the rows of a table's files, and those before them; no column is read, and the window is over a row a file."""
    files = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    return files.select("file", F.coalesce(before, F.lit(0)).alias("start"), "n")


def numbered(spark: SparkSession, path: str, columns: Sequence[str] | None = None, name: str = "ordinal") -> DataFrame:
    """A Parquet table with ``name``: 0, 1, ... along the files, from the numbers of rows before each file."""
    rows = placed(spark, path, columns, "_at")
    if name in rows.columns:
        raise ValueError(f"the table has a column {name}")
    starts = file_starts(spark, path).select(F.col("file").alias("_file"), F.col("start").alias("_start"))
    out = rows.join(F.broadcast(starts), F.col("_at.file") == F.col("_file"))  # a row a file; by a shuffle all rows of a file would meet in one task
    return out.select(*(F.col(f"`{c}`") for c in rows.columns if c != "_at"), (F.col("_start") + F.col("_at.row")).alias(name))


def first_per_key(df: DataFrame, key: str, order: Sequence[Column | str] = (), position: str = "position") -> DataFrame:
    """One row for each key: the one that comes first by ``order`` and, among its ties, by position; the first of a stable sort. Null keys are one key. Position is left out.

    Each task keeps one row a key before the shuffle, so a hot key costs no more than another. Nulls in ``order`` come first, as Spark sorts them.
    """
    others = [c for c in df.columns if c not in (key, position)]
    least = F.min_by(F.struct(*(F.col(f"`{c}`") for c in others)), F.struct(*order, F.col(position))) if others else F.lit(None)
    return df.groupBy(F.col(f"`{key}`")).agg(least.alias("_r")).select(F.col(f"`{key}`"), *(F.col("_r").getField(c).alias(c) for c in others))


def stable_ranked(df: DataFrame, by: Column, *, descending: bool = False, rank: str = "rn", total: str | None = None, position: str = "position") -> DataFrame:
    """df with ``rank``: the place of each row in a stable sort by a numeric column, nulls last; rows that tie keep the order of the files. No task orders more than about its share, whatever the ties."""
    return ranked(df, by, [position], descending=descending, rank=rank, total=total)
