"""Connected components of a graph that is spread over executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import checkpointed

#: Up to so many edges are contracted in one task, by one job: the rounds of more take some eight jobs each, all of which the driver plans and keeps.
SMALL = 100_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of edges that one task holds: every node points to a smaller one of its component, the smallest to itself."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(u), top(v)
            above[max(a, b)] = min(a, b)
    for part in pa.Table.from_pydict({"node": list(above), "component": [top(x) for x in above]}, pa.schema([("node", pa.int64()), ("component", pa.int64())])).to_batches():
        yield part


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v): the smallest node of its component. Loops and repeated edges don't matter.

    Star contraction: every node is linked to the smallest of its neighbours, first from all its neighbours, then from the smaller ones,
    until nothing changes. Neighbours are only ever reduced to their minimum, so a node with very many is no large group. Up to SMALL edges are contracted in one task instead.
    """
    if edges.count() <= SMALL:
        return gathered(edges.where("u <> v").select("u", "v"), 1).mapInArrow(_contracted, "node long, component long")
    now = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    tops = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)


def gathered(df: DataFrame, parts: int | None) -> DataFrame:
    """df in so few partitions; what follows in one partition needs no shuffle."""
    return df if parts is None else df.coalesce(parts)


def kept(df: DataFrame, parts: int | None) -> DataFrame:
    """checkpointed(), in as few partitions afterwards."""
    return gathered(checkpointed(gathered(df, parts)), parts)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
