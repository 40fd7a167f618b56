"""Queries on how tables are stored: the order of rows in files, and differences of two versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import hashtree as H
from ..sources import positions as P
from ..sources.tables import read_table, shared_folder

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


#: Line items stand in their file in no order of their keys.
_ITEMS = "WITH i AS (SELECT *, row_number() OVER () - 1 AS ordinal FROM lineitem) "


@query(_ITEMS + "SELECT l_orderkey, arg_min(l_partkey, ordinal) AS l_partkey, arg_min(l_linenumber, ordinal) AS l_linenumber, arg_min(l_quantity, ordinal) AS l_quantity FROM i GROUP BY l_orderkey")
def first_per_key_by_position(spark: SparkSession, d: str) -> DataFrame:
    """The line item of every order that stands first in the file."""
    return P.first_per_key(P.placed(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"]), "l_orderkey")


@query(_ITEMS + "SELECT l_suppkey, arg_min(l_orderkey, (l_shipdate, ordinal)) AS l_orderkey, arg_min(l_linenumber, (l_shipdate, ordinal)) AS l_linenumber, min(l_shipdate) AS l_shipdate FROM i GROUP BY l_suppkey")
def earliest_by_position(spark: SparkSession, d: str) -> DataFrame:
    """The earliest line item of every supplier; of one day's, the one that stands first."""
    return P.first_per_key(P.placed(spark, f"{d}/lineitem.parquet", ["l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate"]), "l_suppkey", ["l_shipdate"])


@query(_ITEMS + "SELECT ordinal, l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_quantity DESC, ordinal) AS rn FROM i")
def stable_rank(spark: SparkSession, d: str) -> DataFrame:
    """Line items by falling quantity, which has fifty values; ties in the order of the file."""
    rows = P.numbered(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"])
    return P.stable_ranked(rows, F.col("l_quantity"), descending=True, position="ordinal").select("ordinal", "l_orderkey", "l_linenumber", "rn")


_VERSIONS = """WITH r AS (SELECT * REPLACE (CASE WHEN o_orderkey % 991 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 331 = 7 THEN NULL ELSE o_orderstatus END AS o_orderstatus) FROM orders WHERE o_orderkey % 997 <> 5
UNION ALL SELECT * REPLACE (o_orderkey + 1000000000000 AS o_orderkey) FROM orders WHERE o_orderkey % 1009 = 1)
SELECT o_orderkey, CASE WHEN l.o_custkey IS NULL THEN 'added' WHEN r.o_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
CASE WHEN l.o_custkey IS NULL OR r.o_custkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN l.o_orderstatus IS DISTINCT FROM r.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN l.o_totalprice <> r.o_totalprice THEN 'o_totalprice' END) END AS columns
FROM orders l FULL JOIN r USING (o_orderkey) WHERE l.o_custkey IS NULL OR r.o_custkey IS NULL OR l.o_orderstatus IS DISTINCT FROM r.o_orderstatus OR l.o_totalprice <> r.o_totalprice"""


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders, and a later version of them with changes, gaps and new rows."""
    orders = read_table(spark, d, "orders")
    key = F.col("o_orderkey")
    new = orders.where(key % 1009 == 1).withColumn("o_orderkey", key + 1_000_000_000_000)
    later = orders.where(key % 997 != 5).withColumns({"o_totalprice": F.col("o_totalprice") + F.when(key % 991 == 3, 1.0).otherwise(0.0), "o_orderstatus": F.when(key % 331 != 7, F.col("o_orderstatus"))})
    return orders, later.unionByName(new)


@query(_VERSIONS)
def version_diff(spark: SparkSession, d: str) -> DataFrame:
    """What a later version of the orders has changed, of two tables without trees."""
    return H.frames_diff(*_versions(spark, d), ["o_orderkey"]).select("o_orderkey", "change", F.array_join("columns", ",").alias("columns"))


@query(_VERSIONS)
def stored_diff(spark: SparkSession, d: str) -> DataFrame:
    """The same of two tables that are stored with their trees, of which only the leaves that differ are read. The files stay in the shared folder."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    bits = max(4, H.bits_for(read_table(spark, d, "orders", []).count()))
    for name, rows in zip(("left", "right"), _versions(spark, d), strict=True):
        H.write_hashed(rows, f"{folder}/{name}", ["o_orderkey"], bits=bits)
    return H.tree_diff(spark, f"{folder}/left", f"{folder}/right", ["o_orderkey"]).select("o_orderkey", "change", F.array_join("columns", ",").alias("columns"))
