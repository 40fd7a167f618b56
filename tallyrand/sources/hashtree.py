"""Tables stored with a tree of digests, so that the rows in which two of them differ are found by descending, and only the leaves that differ are read.

A row belongs to the leaf that the first bits of its key's hash name. A table is a folder with ``rows``, one directory a leaf, and ``tree``, the digests of all nodes: sums of two hashes of the rows, so that a node's
digest is the sum of its children's, rows may be repeated, and their order and files don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAF = "_leaf"
#: Rows that a leaf should have about, and the most bits of a leaf.
LEAF_ROWS, MOST_BITS = 1_000_000, 16
_SUM = "decimal(38,0)"


def _text(c: str) -> Column:
    """A column as text that tells null from empty, in arrays and structs too."""
    return F.coalesce(F.to_json(F.struct(F.col(f"`{c}`").alias("v"))), F.lit("\x00"))


def _hashed(seed: int, *parts: Column) -> Column:
    return F.xxhash64(F.lit(seed), *parts).cast(_SUM)


def _leaf(keys: Sequence[str], bits: int) -> Column:
    if not bits:
        return F.lit(0)
    return F.shiftrightunsigned(F.xxhash64(F.lit(0), *(_text(k) for k in keys)), 64 - bits).cast("int")


def _checked(columns: Sequence[str], keys: Sequence[str]) -> None:
    if missing := [k for k in keys if k not in columns]:
        raise ValueError(f"no columns {missing}")
    if clash := [c for c in columns if c.lower() == LEAF]:
        raise ValueError(f"the table has a column {clash[0]}")


def bits_for(rows: int, leaf_rows: int = LEAF_ROWS) -> int:
    """Bits of a leaf for leaves of about ``leaf_rows``."""
    return min(MOST_BITS, max(0, math.ceil(math.log2(max(1, rows) / leaf_rows))))


def write_hashed(df: DataFrame, folder: str, keys: Sequence[str], *, bits: int = 8) -> None:
    """Writes df and its tree. Tables that are to be compared need the same keys and bits; ``bits`` grows with the table (bits_for()).

    The rows are shuffled once, by leaf, and leaves that are too large for a task are split as the shuffle ends; the tree is summed from the files written. Null keys are keys like others. One key's rows are in one leaf.
    """
    _checked(df.columns, keys)
    leaves = df.withColumn(LEAF, _leaf(keys, bits))
    leaves.hint("rebalance", LEAF).write.mode("overwrite").partitionBy(LEAF).parquet(f"{folder}/rows")
    if df.isEmpty():  # partitioned writers leave no schema behind without rows
        leaves.limit(0).drop(LEAF).write.mode("overwrite").parquet(f"{folder}/rows/{LEAF}=0")
    rows = df.sparkSession.read.schema(leaves.schema).parquet(f"{folder}/rows")
    own = sorted(df.columns)
    leaf = rows.groupBy(F.col(LEAF).alias("node")).agg(F.count("*").alias("n"), *(F.sum(_hashed(k, *(x for c in own for x in (F.lit(c), _text(c))))).alias(a) for k, a in ((1, "a"), (2, "b"))))
    levels = [leaf.withColumn("level", F.lit(bits))]
    for level in range(bits - 1, -1, -1):
        up = levels[0].groupBy(F.shiftright("node", bits - level).alias("node")).agg(*(F.sum(c).cast("long" if c == "n" else _SUM).alias(c) for c in ("n", "a", "b")))
        levels.append(up.withColumn("level", F.lit(level)))
    tree = levels[0]
    for up in levels[1:]:
        tree = tree.unionByName(up)
    tree.select("level", "node", "n", "a", "b").coalesce(1).write.mode("overwrite").partitionBy("level").parquet(f"{folder}/tree")


def read_hashed(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a table with a tree, without what the tree needs."""
    return spark.read.parquet(f"{folder}/rows").drop(LEAF)


def _tree(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("node int, n long, a decimal(38,0), b decimal(38,0), level int").parquet(f"{folder}/tree")


def depth(spark: SparkSession, folder: str) -> int:
    return _tree(spark, folder).agg(F.max("level")).first()[0] or 0


def differing_leaves(spark: SparkSession, left: str, right: str) -> list[int]:
    """Leaves in which two tables differ, found level by level from the root; at most 2 to the power of MOST_BITS numbers. Equal tables cost one look at both roots."""
    a, b = _tree(spark, left), _tree(spark, right)
    deep = depth(spark, left), depth(spark, right)
    if deep[0] != deep[1] and min(a.where("level = 0").count(), b.where("level = 0").count()):
        raise ValueError(f"trees of {deep[0]} and {deep[1]} bits can't be compared")
    open_nodes = [0]
    for level in range(max(deep) + 1):
        # A parent's children are 2 * node and 2 * node + 1.
        under = F.lit(True) if level == 0 else F.shiftright("node", 1).isin(open_nodes) if len(open_nodes) <= 1000 else F.lit(True)
        x, y = (t.where((F.col("level") == level) & under).select("node", *(F.col(c).alias(f"{c}_{side}") for c in ("n", "a", "b"))) for t, side in ((a, "l"), (b, "r")))
        same = F.lit(True)
        for c in ("n", "a", "b"):
            same &= F.col(f"{c}_l").eqNullSafe(F.col(f"{c}_r"))
        open_nodes = sorted(r.node for r in x.join(y, "node", "full").where(~same).select("node").collect())
        if not open_nodes:
            return []
    return open_nodes


def _signed(df: DataFrame, keys: Sequence[str], names: Sequence[str], sign: int) -> DataFrame:
    """(keys..., _sign, _whole, _0, _1, ...): signed hashes of each row and of each of its columns in ``names``."""
    own = sorted(set(df.columns) - {LEAF})
    whole = _hashed(3, *(x for c in own for x in (F.lit(c), _text(c))))
    each = (((_hashed(4, _text(c)) if c in own else F.lit(1)) * sign).cast(_SUM).alias(f"_{i}") for i, c in enumerate(names))
    return df.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), F.lit(sign).alias("_sign"), (whole * sign).cast(_SUM).alias("_whole"), *each)


def _changes(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What tree_diff() tells, of rows that may differ."""
    names = sorted((set(left.columns) | set(right.columns)) - {LEAF, *keys})
    both = _signed(left, keys, names, 1).unionByName(_signed(right, keys, names, -1))
    counts = [F.count_if(F.col("_sign") == sign).alias(side) for sign, side in ((1, "_l"), (-1, "_r"))]
    held = both.groupBy(*(f"_k{i}" for i in range(len(keys)))).agg(*counts, *(F.sum(c).alias(c) for c in ("_whole", *(f"_{i}" for i in range(len(names))))))
    none = F.array().cast("array<string>")
    change = F.when(F.col("_l") == 0, "added").when(F.col("_r") == 0, "removed").otherwise("changed")
    columns = F.array_compact(F.array(*(F.when(F.col(f"_{i}") != 0, F.lit(c)) for i, c in enumerate(names)))) if names else none
    out = held.where((F.col("_whole") != 0) | (F.col("_l") != F.col("_r")))
    return out.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), change.alias("change"), F.when(change == "changed", columns).otherwise(none).alias("columns"))


def tree_diff(spark: SparkSession, left: str, right: str, keys: Sequence[str]) -> DataFrame:
    """(keys..., change, columns): keys whose rows differ, ``added``, ``removed`` or ``changed``, and in the last case the columns whose values do, in order of their names.

    Only the directories of leaves that differ are read. A key may have several rows: its rows are compared as multisets, column by column, and it is changed too where columns have the same values in other combinations (``columns`` is then empty).
    Columns that one side lacks count as changed for every key that both sides have. One shuffle by key, of those rows' hashes summed before it.
    """
    sides = [spark.read.parquet(f"{f}/rows") for f in (left, right)]
    for s in sides:
        if missing := [k for k in keys if k not in s.columns]:
            raise ValueError(f"no columns {missing}")
    leaves = differing_leaves(spark, left, right)
    return _changes(*(s.where(F.col(LEAF).isin(leaves)) if leaves else s.where(F.lit(False)) for s in sides), keys)


def frames_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], *, bits: int = 12) -> DataFrame:
    """As tree_diff(), of tables without trees: a first scan of both sums each leaf, and of a second one only the rows of leaves that differ are shuffled. Up to 2 to the power of ``bits`` leaves are sent to the tasks."""
    _checked(left.columns, keys)
    _checked(right.columns, keys)

    def sums(df: DataFrame, sign: int) -> DataFrame:
        own = sorted(df.columns)
        row = [x for c in own for x in (F.lit(c), _text(c))]
        return df.groupBy(_leaf(keys, bits).alias(LEAF)).agg((F.count("*") * sign).alias("n"), *(F.sum((_hashed(k, *row) * sign).cast(_SUM)).alias(a) for k, a in ((1, "a"), (2, "b"))))

    both = sums(left, 1).unionByName(sums(right, -1)).groupBy(LEAF).agg(*(F.sum(c).alias(c) for c in ("n", "a", "b")))
    leaves = F.broadcast(both.where((F.col("n") != 0) | (F.col("a") != 0) | (F.col("b") != 0)).select(LEAF))
    return _changes(*(df.withColumn(LEAF, _leaf(keys, bits)).join(leaves, LEAF, "left_semi") for df in (left, right)), keys)
