"""Positions of rows in files against the order in which they were written."""

import pytest
from pyspark.sql import functions as F

from tallyrand.sources import positions as P


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """300 rows in five files, which hold ordinals in order; keys and scores in none."""
    path = str(tmp_path_factory.mktemp("positions") / "t")
    rows = spark.range(0, 300, 1, 5).select(F.col("id").alias("want"), (F.col("id") * 7919 % 23).alias("k"), (F.col("id") * 31 % 4 / 4.0).alias("s"), F.lit("x").alias("file"))
    rows.write.parquet(path)
    return path


def test_ordinals_are_the_order_of_the_files(spark, table):
    assert len({r.file for r in P.file_starts(spark, table).collect()}) == 5
    rows = P.numbered(spark, table).collect()
    assert all(r.ordinal == r.want for r in rows) and len(rows) == 300
    assert rows[0].file == "x"  # a column of the table with a clashing name
    by = [r.want for r in P.placed(spark, table, ["want"]).orderBy("position").collect()]
    assert by == list(range(300))


def test_small_splits_of_one_file(spark, tmp_path):
    """A file of many row groups that is read by several tasks."""
    path = str(tmp_path / "t")
    spark.range(0, 40_000, 1, 1).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).write.option("parquet.block.size", 64 * 1024).parquet(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 256 * 1024)
    try:
        rows = P.numbered(spark, path, ["id"])
        assert rows.rdd.getNumPartitions() > 3
        assert rows.where("id <> ordinal").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_first_rows_are_those_of_a_stable_sort(spark, table):
    rows = [r.asDict() for r in spark.read.parquet(table).collect()]
    first, least = {}, {}
    for r in sorted(rows, key=lambda r: r["want"]):
        first.setdefault(r["k"], r["want"])
    for r in sorted(rows, key=lambda r: (r["s"], r["want"])):
        least.setdefault(r["k"], r["want"])
    placed = P.placed(spark, table)
    assert {r.k: r.want for r in P.first_per_key(placed, "k").collect()} == first
    got = P.first_per_key(placed, "k", ["s"])
    assert got.columns == ["k", "want", "s", "file"]
    assert {r.k: r.want for r in got.collect()} == least


def test_stable_ranks(spark, table):
    got = P.stable_ranked(P.placed(spark, table), F.col("s"), descending=True, total="n").collect()
    want = sorted((r.asDict() for r in spark.read.parquet(table).collect()), key=lambda r: (-r["s"], r["want"]))
    assert {r.want: r.rn for r in got} == {r["want"]: i + 1 for i, r in enumerate(want)}
    assert {r.n for r in got} == {300}


def test_zeros_in_falling_order(spark):
    """Zeros become negative when keys are turned; in ranges they then stood before larger keys."""
    rows = spark.range(300).select("id", (F.col("id") * 31 % 4 / 4.0).alias("s"))
    for shift in range(4):
        got = P.stable_ranked(rows.withColumn("at", F.concat(F.lit(str(shift)), F.lpad(F.col("id").cast("string"), 4, "0"))), F.col("s"), descending=True, position="at").collect()
        assert [r.id for r in sorted(got, key=lambda r: r.rn)] == sorted(range(300), key=lambda i: (-(i * 31 % 4), i))


def test_no_shuffle_by_file(spark, table):
    plan = P.numbered(spark, table)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_clashes_and_empty_tables(spark, tmp_path):
    spark.range(3).select(F.col("id").alias("position"), F.col("id").alias("ordinal")).write.parquet(f"{tmp_path}/a")
    with pytest.raises(ValueError):
        P.placed(spark, f"{tmp_path}/a")
    with pytest.raises(ValueError):
        P.numbered(spark, f"{tmp_path}/a")
    spark.createDataFrame([], "k long, v string").write.parquet(f"{tmp_path}/e")
    assert P.numbered(spark, f"{tmp_path}/e").collect() == []
    assert P.first_per_key(P.placed(spark, f"{tmp_path}/e"), "k").collect() == []
    spark.createDataFrame([(None, "a"), (1, None), (None, "b")], "k long, v string").coalesce(1).write.parquet(f"{tmp_path}/n")
    assert {r.k: r.v for r in P.first_per_key(P.placed(spark, f"{tmp_path}/n"), "k").collect()} == {None: "a", 1: None}


def test_only_asked_columns_are_read(spark, table):
    plan = P.placed(spark, table, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<k:bigint" in plan and "want" not in plan.split("ReadSchema")[1]
