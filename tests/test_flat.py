"""Flat versions: their columns, samples, caps, leaks and gaps, and what they refuse."""

import pytest
from pyspark.sql import functions as F

from tallyrand.operators import flat
from tallyrand.operators import snapshots as N
from tallyrand.plans import given

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def world(spark):
    return given.given_world(spark, SF)


@pytest.fixture(scope="module")
def shots(spark, world):
    return {day: N.lead_snapshot(world, window=day).cache() for day in (10, 20)}


def built(world, shots, name, **more):
    v = flat.VERSIONS[name]
    return flat.build(shots[v.day], v, touches=world["touches"], **more).cache()


def test_columns_of_each_version(world, shots):
    student = [c for c in flat.NAMES.values() if not c.startswith(flat.LEAKAGE)]
    for name in ("v6", "v7", "midproject"):
        assert built(world, shots, name).columns == student
    after = f"{flat.LEAKAGE}touches_post_snapshot_21_90"
    for name in ("v6", "v7"):
        assert built(world, shots, name, instructor=True).columns == [*student, after]
    v5 = built(world, shots, "v5").columns
    assert len(v5) == 19 and v5[-2:] == [f"{flat.LEAKAGE}total_touches_90d", "converted"]
    v4 = built(world, shots, "v4").columns
    assert len(v4) == 18 and v4[-2:] == ["total_touches_all", "converted"] and "days_since_first_touch" not in v4
    assert len(student) == 20


@pytest.mark.parametrize("name", sorted(flat.VERSIONS))
def test_sizes_rates_caps_and_gaps(world, shots, name):
    v = flat.VERSIONS[name]
    rows = built(world, shots, name)
    assert rows.count() == v.n and rows.where("converted = 1").count() == int(v.n * v.rate + 0.5)
    low, high = rows.agg(F.min("expected_acv"), F.max("expected_acv")).first()
    assert (low >= v.bounds[0] and high <= v.bounds[1]) is (v.cap is not None)
    for column, (rates, _) in flat.GAPS[v.gaps].items():
        if column in ("web_sessions", "seniority"):
            sent = rows.where("lead_source = 'sdr_outbound'" if column == "web_sessions" else "lead_source = 'partner_referral'")
            share = sent.where(F.col(column).isNull()).count() / sent.count()
            want = rates.get("sdr_outbound" if column == "web_sessions" else "partner_referral")
            assert abs(share - want) < 0.12, (column, share)
    assert rows.where(F.col("lead_source").isNull()).count() == 0


def test_students_and_instructors_see_the_same_leads(world, shots):
    leak = flat.VERSIONS["v7"].leak
    assert built(world, shots, "v7").exceptAll(built(world, shots, "v7", instructor=True).drop(leak)).count() == 0
    plain, boosted = (built(world, shots, name, instructor=True) for name in ("v7", "v6"))
    total = lambda df, y: df.where(F.col("converted") == y).agg(F.sum(leak)).first()[0]
    assert total(plain, 0) == total(boosted, 0)
    assert 2 < (total(boosted, 1) - total(plain, 1)) / 300 < 4  # a Poisson(3) count each


def test_touches_after_the_snapshot(spark):
    leads = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-01"), ("c", None)], "lead_id string, lead_created_at string")
    days = [("a", 20), ("a", 21), ("a", 90), ("a", 91), ("b", 3), ("x", 30), ("c", 30)]
    touches = spark.createDataFrame(days, "lead_id string, d int").select("lead_id", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")), "yyyy-MM-dd").alias("touch_timestamp"))
    assert {r.lead_id: r.touches_after for r in flat.touches_after(touches, leads, 20).collect()} == {"a": 2}


def test_what_is_refused_and_refilled(world, shots):
    from dataclasses import replace

    v7, v4 = flat.VERSIONS["v7"], flat.VERSIONS["v4"]
    with pytest.raises(ValueError):
        flat.build(shots[20], v7, instructor=True)
    with pytest.raises(ValueError):
        flat.build(shots[20], flat.VERSIONS["midproject"], instructor=True)
    with pytest.raises(ValueError):
        flat.build(shots[20], replace(v7, n=1400, rate=0.5))
    filled = flat.build(shots[10], replace(v4, n=1400, rate=0.5))  # 493 converted orders, 1007 others
    assert {r.converted: r["count"] for r in filled.groupBy("converted").count().collect()} == {1: 493, 0: 907}
    short = flat.build(shots[10], replace(v4, n=5000, rate=0.01))
    assert {r.converted: r["count"] for r in short.groupBy("converted").count().collect()} == {1: 50, 0: 1007}
    with pytest.raises(ValueError):
        flat.build(shots[20].limit(0), v7)
    assert flat.build(shots[10].limit(0), v4).count() == 0


def test_events_of_given_leads_are_shuffled_once_and_counted_by_hashing(spark):
    """They were shuffled by order and again by lead, and sorted for the earliest opportunity."""
    from conftest import SF
    from tallyrand.plans import given

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shot = given.lead_snapshot_at(10, spark, SF)
        assert shot.count() == 1500
        plan = shot._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "l_orderkey" not in "".join(line for line in plan.splitlines() if "hashpartitioning" in line)
    assert "HashAggregate" in plan


def test_large_samples_are_taken_by_a_bound(spark, monkeypatch):
    """Samples of more than TOP_ROWS rows were sorted in one task; the bound gives the same rows, also where keys repeat."""
    from tallyrand.operators import sampling

    rows = spark.range(4000).select((F.col("id") % 1500).alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    for n in (7, 300, 3999 - 1333):
        small = sampling.stratified(rows, "k", "y", n, 0.4, seed=3).groupBy("k", "y").count()
        monkeypatch.setattr(sampling, "TOP_ROWS", 0)
        made = sampling.stratified(rows, "k", "y", n, 0.4, seed=3)
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Sort" not in plan
        assert sorted(map(tuple, made.groupBy("k", "y").count().collect())) == sorted(map(tuple, small.collect()))
        monkeypatch.undo()
