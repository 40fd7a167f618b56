"""Panels, timelines and rechecks against loops, also with most rows under one key."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyrand.operators import audit as A
from tallyrand.operators import pointintime as P
from tallyrand.operators import timelines as T


def test_panel_with_one_hot_key(spark):
    rng = random.Random(1)
    events = [(1 if i % 2 else rng.randint(2, 40), rng.randint(-50, 900), rng.randint(0, 9)) for i in range(4000)] + [(None, 5, 1), (3, None, 1), (3, 7, None)]
    cutoffs = [(k, c) for k in [1, *range(30, 45)] for c in range(-100, 1000, 90)] + [(None, 5), (7, None)]
    df = T.panel(spark.createDataFrame(events, "k int, day int, v int"), spark.createDataFrame(cutoffs, "k int, cutoff int"), "k", {"ahead": (0, 90, "v"), "far": (0, 365, "v"), "back": (-30, 0, "v")}, bucket=64)
    total = lambda k, a, b: sum(v or 0 for key, day, v in events if k is not None and key == k and day is not None and a < day <= b)
    got = {(r.k, r.cutoff): (r.ahead, r.far, r.back) for r in df.collect()}
    assert len(got) == len(cutoffs)
    for k, c in cutoffs:
        assert got[k, c] == ((0, 0, 0) if c is None else (total(k, c, c + 90), total(k, c, c + 365), total(k, c - 30, c)))


def test_no_task_gets_all_rows_of_a_key(spark):
    """Half of all events are one key's: after the first aggregation they are dealt by buckets, too."""
    events = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") + 1).alias("k"), (F.col("id") % 5000).cast("int").alias("day"), F.lit(1).alias("v"))
    asked = spark.createDataFrame([(1, 4999)], "k long, day int")
    out = T.sums_until(events, asked, "k", ["v"])
    assert out.first().v == 10_000
    assert "hashpartitioning(k" in out._jdf.queryExecution().toString() and "_bucket" in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("bucket", [7, 128])
def test_intervals_and_states(spark, bucket):
    rng = random.Random(2)
    changes = [(rng.choice([1, 1, 1, 2, 3]), rng.randint(0, 300), rng.choice(["a", "b", None]), i) for i in range(400)] + [(None, 3, "a", 900), (2, None, "b", 901)]
    timeline = T.intervals(spark.createDataFrame(changes, "k int, day int, state string, tie int"), "k", "state", "tie", bucket)
    want = []
    for k in (1, 2, 3):
        held = {}
        for _, day, s, tie in sorted((c for c in changes if c[0] == k and c[1] is not None), key=lambda c: c[3]):
            held[day] = s
        own = [(d, held[d]) for d in sorted(held)]
        kept = [x for i, x in enumerate(own) if not i or own[i - 1][1] != x[1]]
        want += [(k, s, d, kept[i + 1][0] if i + 1 < len(kept) else None) for i, (d, s) in enumerate(kept)]
    key = lambda r: (r[0], r[2])
    assert sorted(map(tuple, timeline.collect()), key=key) == sorted(want, key=key)
    asked = [(k, d, "x") for k in (1, 2, 3, 4) for d in range(-5, 320, 13)]
    got = {(r.k, r.day): (r.state, r.since) for r in T.state_asof(timeline, spark.createDataFrame(asked, "k int, day int, more string"), "k", "state", bucket).collect()}
    for k, d, _ in asked:
        own = [(s, a) for key, s, a, b in want if key == k and a <= d and (b is None or d < b)]
        assert got[k, d] == (own[0] if own else (None, None))


def test_asked_rows_of_states_are_dealt_and_not_sorted(spark, monkeypatch):
    """A customer file is one split: its months were made, sorted and aggregated in one task."""
    from conftest import SF
    from tallyrand.plans import timelines as plans

    monkeypatch.setattr(plans, "CUSTOMERS", 10)
    sizes = plans._months(spark, SF).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 10 and sum(r["count"] for r in sizes) == 150 * 67
    timeline, asked = (spark.range(9).select("id", *more) for more in ([F.lit("a").alias("s"), F.lit(3).alias("valid_from")], [F.lit(5).alias("day"), F.lit("x").alias("more")]))
    plan = T.state_asof(timeline, asked, "id", "s")._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "Window" not in plan and "Sort" not in plan


def test_cutoffs_of_a_panel_are_neither_multiplied_nor_sorted(spark):
    events, cutoffs = spark.range(9).select("id", F.lit(3).alias("day"), F.lit(1).alias("v")), spark.range(9).select("id", F.lit(5).alias("cutoff"))
    plan = T.panel(events, cutoffs, "id", {"a": (-9, 0, "v"), "b": (0, 9, "v")})._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "Generate" not in plan and "Union" not in plan


LEADS = [(1, "2024-01-01", True, 10.0), (2, "2024-01-01", False, None), (3, "2024-01-01", None, 5.0), (4, "2024-01-01", True, None), (5, "2024-01-01", True, 7.0)]
OPEN = [(1, 1, "2024-01-05", None, 10.0), (1, 2, "2024-01-02", "2024-01-20", 20.0), (2, 3, "2024-01-05", "2024-03-01", 8.0), (4, 4, "2024-01-05", None, None), (5, 5, "2024-02-05", None, 7.0), (9, 6, "2024-01-01", None, 1.0)]


def _tables(spark, leads):
    return spark.createDataFrame(leads, "lead_id int, lead_created_at string, has_open_opportunity boolean, opportunity_estimated_acv double"), spark.createDataFrame(OPEN, "lead_id int, opportunity_id int, created_at string, closed_at string, estimated_acv double")


def test_open_recheck(spark):
    leads, opportunities = _tables(spark, LEADS)
    got = {r["column"]: (r.n, r.n_mismatched) for r in T.open_recheck(leads, opportunities, days=30).collect()}
    # 1 is right, 2 was open, 3 has no opportunity but a value, 4 is right, 5's came later.
    assert got == {"has_open_opportunity": (5, 2), "opportunity_estimated_acv": (5, 3)}
    assert {r.n for r in T.open_recheck(leads.limit(0), opportunities, days=30).collect()} == {0}
    with pytest.raises(P.SnapshotError, match="closed_at"):
        T.open_recheck(leads, opportunities.drop("closed_at"), days=30)
    with pytest.raises(PySparkException, match="repeated lead_id 5"):
        T.open_recheck(leads.unionByName(leads.where("lead_id = 5")), opportunities, days=30).collect()


def test_orphans_raise(spark):
    events = spark.createDataFrame([(1, "2024-01-02"), (2, "2024-01-03"), (7, "2024-01-03")], "lead_id int, ts string")
    anchors = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-01")], "lead_id int, anchor string").withColumn("anchor", F.to_date("anchor"))
    with pytest.raises(PySparkException, match="event without an anchor: lead_id 7"):
        P.safe_events(events, anchors, key="lead_id", ts="ts", window=5, orphans="raise").collect()
    assert P.safe_events(events, anchors, key="lead_id", ts="ts", window=5).count() == 2
    assert P.safe_events(events.where("lead_id < 7"), anchors, key="lead_id", ts="ts", window=5, orphans="raise").count() == 2
    with pytest.raises(P.SnapshotError, match="drop or raise"):
        P.with_day(events, anchors, "lead_id", "ts", "keep")


def test_channel_audits_of_odd_columns(spark):
    rows = [("x", True, 1, "a", "one"), ("x", True, 0, "b", "one"), ("x", True, None, None, "one"), ("x", False, 1, "a", "one"), ("x", False, 0, "new", "one"), ("y", False, 1, "a", "one")]
    df = spark.createDataFrame(rows, "tier string, t boolean, y int, c string, same string")
    got = {(r.tier, r.column): r for r in A.channel_audits(df, ["c", "same"], "y", F.col("t"), "tier").collect()}
    assert got["x", "c"].n_values == 3 and got["x", "c"].spread == 1.0 and got["x", "c"].auc_train == 1.0 and got["x", "c"].auc_test == 1.0
    assert got["x", "same"].auc_train == 0.5 and got["y", "c"].n_train == 0 and got["y", "c"].auc_test == 0.5
    assert A.channel_audits(df.limit(0), ["c"], "y", F.col("t"), "tier").collect() == []
    plan = A.channel_audits(df, ["c", "same"], "y", F.col("t"), "tier")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
