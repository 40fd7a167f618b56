import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrand import api
from tallyrand.functions import random as U
from tallyrand.functions import scalars as S
from tallyrand.generate import graph
from tallyrand.operators import audit as A
from tallyrand.operators import models as M
from tallyrand.operators import quality as Q
from tallyrand.operators import ranking as R
from tallyrand.operators import sampling as G
from tallyrand.sources import bundle


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_draws(spark):
    rows = spark.range(20000).select(U.uniform(1, "a", F.col("id")).alias("u"), U.normal(1, "n", F.col("id")).alias("z"), U.poisson(F.lit(2.0), U.fast_uniform(1, "p", F.col("id"))).alias("k"), U.geometric(F.lit(0.25), U.fast_uniform(1, "g", F.col("id"))).alias("g"))
    m = rows.agg(F.avg("u"), F.avg("z"), F.stddev("z"), F.avg("k"), F.variance("k"), F.avg("g"), F.min("g")).first()
    for got, want in zip(m, (0.5, 0, 1, 2, 2, 4, 1), strict=True):
        assert abs(got - want) < 0.1


def test_scalar_edges(spark):
    got = one(spark, S.floor_weeks(F.lit(-1)), S.half_even(F.lit(2.5)), S.half_up(F.lit(2.5)), S.ratio(F.lit(1.0), F.lit(0.0)), S.clipped(F.lit(None).cast("double"), 0, 1), S.day_of(F.lit("not a day")), S.entity_id("lead", F.lit(7)))
    assert list(got) == [-1, 2.0, 3, None, None, None, "lead_000007"]


def test_renewal_weeks_against_a_loop(spark):
    rows = spark.range(0, 200).withColumn("term", F.lit(6)).select("id", S.is_renewal_week(F.col("id"), F.col("term")).alias("is"), S.next_renewal_week(F.col("id"), F.col("term")).alias("next")).collect()
    weeks = [round(k * 26) for k in range(1, 20)]
    for r in rows:
        assert r["is"] == (r.id in weeks) and r.next == min(w for w in weeks if w > r.id)


def test_ranked_is_a_global_order(spark):
    rng = random.Random(1)
    data = [(i, rng.choice([1.0, 2.0, 2.5, None, rng.random()])) for i in range(500)]
    got = {r.i: r.rn for r in R.ranked(spark.createDataFrame(data, "i int, x double"), F.col("x"), ["i"], descending=True, total="n").collect()}
    want = [i for i, _ in sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    assert [i for i, _ in sorted(got.items(), key=lambda r: r[1])] == want


def test_auc_against_pairs(spark):
    rng = random.Random(2)
    data = [(rng.randint(0, 1), round(rng.random(), 1)) for _ in range(120)]
    df = spark.createDataFrame(data, "y int, p double")
    pairs = [(a > b) + (a == b) / 2 for y, a in data if y for z, b in data if not z]
    assert math.isclose(R.roc_auc(df).first().auc, sum(pairs) / len(pairs))
    assert R.roc_auc(df.where("y = 1")).first().auc is None


def test_at_k_out_of_range(spark):
    df = R.ranked(spark.createDataFrame([(1, 0.5)], "y int, p double"), F.col("p"), ["y"], total="n")
    assert [r.precision for r in R.at_k(df, [0, 1, 2]).orderBy("k").collect()] == [None, 1.0, None]


def test_audits(spark):
    a = spark.createDataFrame([(1, "a"), (2, None), (3, "z"), (4, "z")], "i int, k string")
    assert [tuple(r) for r in A.orphans(a, "k", spark.createDataFrame([("a",)], "p string"), "p").collect()] == [("z", 2)]
    rows = spark.createDataFrame([("train", 1, 1.00001), ("test", 1, 1.00002), ("test", 2, None)], "split string, k int, x double")
    assert [tuple(r) for r in A.split_overlap(rows, "k").collect()] == [("test", "train", 1)]
    assert A.near_duplicate_rows(rows, ["x"]).first().n_shared == 1
    assert A.repeated_rows(a.select("k")).first().n_repeats == 1
    assert {r.column: r.n_differing for r in A.differing(a, a.withColumn("k", F.lit("a")), "i", ["k"]).collect()} == {"k": 3}


def test_splits_and_samples(spark):
    df = spark.range(101).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    sizes = {r.split: r["count"] for r in G.exact_splits(df, "id", seed=1).groupBy("split").count().collect()}
    assert sizes == {"train": 70, "valid": 15, "test": 16}
    s = G.stratified(df, "id", "y", 20, 0.25, seed=1).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in s} == {1: 5, 0: 15}
    with pytest.raises(ValueError):
        G.stratified(df, "id", "y", 100, 0.9, seed=1)


def test_distortion_leaves_the_rest(spark):
    df = spark.range(400).select("id", F.col("id").cast("double").alias("x"), F.lit(3.0).alias("flat"), F.col("id").alias("kept"))
    out = G.distorted(df, "id", ["x", "flat"], noise=0.3, missing=0.1, outliers=0.05, seed=3, non_negative=["x"])
    assert out.columns == df.columns and out.where("kept <> id").count() == 0
    assert out.where("flat is not null and flat <> 3").count() == 0
    assert 10 < out.where("x is null").count() < 90
    again = G.distorted(df.repartition(7), "id", ["x", "flat"], noise=0.3, missing=0.1, outliers=0.05, seed=3, non_negative=["x"])
    same = lambda d: sorted((r.id, None if r.x is None else round(r.x, 9)) for r in d.collect())
    assert same(out) == same(again)


def test_models_find_signal_and_none_in_ids(spark):
    df = spark.range(600).select("id", F.pmod(F.xxhash64("id"), F.lit(100)).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, "a").alias("c"))
    df = df.withColumn("y", (F.col("x") > 50).cast("int"))
    assert M.auc_of(M.cross_validated(df, "id", ["x", "c"], "y", "lr")) > 0.95
    ids = df.select("id", "y", *M.hashed_id(F.col("id")))
    assert 0.3 < M.auc_of(M.cross_validated(ids, "id", ["h0", "h1"], "y", "lr")) < 0.7


def test_graphs():
    g = graph.sample("intent_dominant", 3)
    order = g.order()
    assert all(order.index(a) < order.index(b) for a, b in g.edges)
    assert graph.sample("intent_dominant", 3).to_json() == g.to_json()
    with pytest.raises(ValueError):
        graph.Graph({"a": "x", "b": "x"}, {("a", "b"): 0.1, ("b", "a"): 0.1}).check()


def test_bundles(spark, tmp_path):
    w = api.generate(spark, "leads_intro", n_leads=40, n_contacts=30, n_accounts=12)
    public, full = f"file://{tmp_path}/public", f"file://{tmp_path}/full"
    manifest = w.save(public, files=1)
    assert "customers" not in manifest["tables"] and api.validate(spark, public) == []
    w.save(full, mode="instructor", files=2)
    assert api.validate(spark, full) == [] and "tables/leads" in bundle.compare_bundles(spark, public, full)
    assert bundle.flat(spark, public, "conversion").count() == 40
    assert "current_stage" not in bundle.flat(spark, public, "conversion").columns
    spark.read.parquet(f"{full}/tables/leads.parquet").limit(39).coalesce(1).write.mode("overwrite").parquet(f"{public}/tables/leads.parquet")
    assert any("leads" in e for e in api.validate(spark, public))


def test_configuration():
    assert api.configured("leads_intro", {"seed": 5}).seed == 5
    with pytest.raises(ValueError):
        api.configured("nothing")
    with pytest.raises(ValueError):
        api.configured("leads_intro", {"label_days": 100})
    with pytest.raises(ValueError):
        api.configured("leads_intro", {"colour": 1})


def test_flat_dataset(spark):
    from tallyrand.generate import leads
    from tallyrand.operators import flat, snapshots

    shot = snapshots.lead_snapshot(leads.simulate(spark, leads.LeadWorld(n_accounts=20, n_contacts=40, n_leads=150)), window=30).cache()
    out = flat.flat_dataset(shot, flat.Flat(n=60, rate=0.3))
    assert out.count() == 60 and out.where("converted = 1").count() == 18
    assert out.where("expected_acv > 120000 or expected_acv < 10000").count() == 0
    assert not [c for c in out.columns if c.startswith(flat.LEAKAGE)]
    assert f"{flat.LEAKAGE}total_touches_90d" in flat.flat_dataset(shot, flat.Flat(n=30, rate=0.3, instructor=True)).columns
    assert {r.acquisition_wave for r in out.select("acquisition_wave").collect()} == set("ABC")
    with pytest.raises(ValueError):
        flat.renamed(out, {"nothing": "x"})


def test_ids_of_any_length(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 999_999, 1_000_000, 1_000_001, 100_000, 12_345_678_901)], "n long")
    got = {r.n: r.id for r in rows.select("n", S.entity_id("cust", F.col("n")).alias("id")).collect()}
    assert len(set(got.values())) == 6
    assert got[1] == "cust_000001" and got[999_999] == "cust_999999" and got[1_000_001] == "cust_1000001"


def test_one_key_for_all_rows_is_ranked_in_several_tasks(spark):
    """Ranges of one key are cut by the ties, also where the key is missing, and the order stays exact."""
    for key in (F.lit(7.0), F.lit(None).cast("double"), F.when(F.col("i") % 3 > 0, 1.0).when(F.col("i") % 2 > 0, F.col("i").cast("double"))):
        df = spark.range(4000).select(F.col("id").alias("i"), F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("t")).withColumn("x", key)
        rows = df.collect()
        want = {r.i: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (r.x is None, r.x or 0, r.t, r.i)))}
        assert {r.i: r.rn for r in R.ranked(df, F.col("x"), ["t", "i"]).collect()} == want
        ranges = R._ranges(df.withColumn("_k", F.col("x")), "_k", ["t", "i"]).groupBy("_range").count().collect()
        assert len(ranges) >= 3 and max(r["count"] for r in ranges) < 2600


def test_exact_quantiles(spark):
    data = [0.0, 1.0, 1.0, 2.5, 7.0, 7.0, 7.0, 9.0, None]
    at = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    got = R.quantiles(spark.createDataFrame([(x,) for x in data], "x double"), "x", at).first()
    own = np.array([x for x in data if x is not None])
    assert all(abs(got[n] - np.quantile(own, q)) < 1e-12 for n, q in at.items())


def test_bands_and_exposure(spark):
    text = "intro:\n  lr_auc: {min: 0.6}\n  rate: {min: 0.1, max: 0.5}\n"
    assert bundle.load_bands(text) == [("intro", "lr_auc", 0.6, None), ("intro", "rate", 0.1, 0.5)]
    with pytest.raises(ValueError):
        bundle.load_bands("intro: {rate: {least: 1}}")
    small, large = ({"tables": dict.fromkeys(t), "tasks": {"c": {"train": 1}}} for t in (("leads",), ("leads", "customers")))
    assert bundle.exposure_errors(small, large) == [] and bundle.exposure_errors(large, small) == ["table customers is public only"]
    names = spark.createDataFrame([("a", "long")], "name string, dtype string")
    assert [tuple(r) for r in bundle.with_dictionary_row(names, {"name": "split"}).collect()] == [("split", ""), ("a", "long")]


def test_unknown_probes_raise(spark):
    one = lambda: spark.createDataFrame([("x", "y", 1)], "probe string, detail string, n long")
    assert Q.findings({"x": one, "z": one}, ["x"]).count() == 1
    with pytest.raises(ValueError):
        Q.findings({"x": one}, ["w"])
