import json

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tallyrand.operators import joint as J
from tallyrand.operators import models as M
from tallyrand.operators import quality as Q
from tallyrand.operators import ranking as R
from tallyrand.operators import release as L
from tallyrand.plans import release as plans
from tallyrand.sources import bundle

TREES = {"trees": 3, "depth": 2}


@pytest.fixture(scope="module")
def rows(spark):
    return M.materialised(plans.family(spark, SF))


@pytest.fixture(scope="module")
def scored(rows):
    return L.scores(rows, "tier", "seed", "o_orderkey", plans.FEATURES, "y", F.col("train"), subsets={"month": ["month"]}, **TREES)


def test_joint_models_are_those_of_each_dataset(spark, rows, scored):
    """The same prepared rows, but each dataset's models fitted by themselves."""
    sets = sorted((r.tier, r.seed) for r in rows.select("tier", "seed").distinct().collect())
    got = {(r.tier, r.seed, r.key, r.model): r.p for r in scored.collect()}
    assert len(got) == 3 * rows.where("not train").count()
    base = rows.select(F.col("o_orderkey").alias("k"), "tier", "seed", "train", "y", *plans.FEATURES)
    ready, shape, places = M.prepared(base, plans.FEATURES, "y", ["k", "tier", "seed", "train"])
    numeric, categorical = M.partitioned(base.select(*plans.FEATURES), [])
    bins = M.materialised(M.binned(base.withColumn("y", F.col("y").cast("double")), base.where("train"), numeric, categorical, ["k", "tier", "seed", "train", "y"]))
    for tier, seed in sets[:2] + sets[-1:]:
        of = (F.col("tier") == tier) & (F.col("seed") == seed)
        own = M.materialised(ready.where(of).withColumn("flags", F.array("train")))
        for model, seen in (("lr", None), ("lr:month", places["month"])):
            weights = J.fit(own, shape, [J.Problem(0, seen)], l2=M.RIDGE)
            for r in J.predicted(own.where("not train"), shape, weights, ["k"]).collect():
                assert got[tier, seed, r.k, model] == pytest.approx(r.p[0], abs=1e-3)
        part = M.materialised(bins.where(of))
        alone = J.fit_boosted(part.where("train"), len(plans.FEATURES), 32, **TREES)
        for r in J.predict_boosted(part.where("not train"), alone, ["k"]).collect():
            assert got[tier, seed, r.k, "gbt"] == pytest.approx(r.p, abs=1e-9)


def test_jobs_do_not_grow_with_datasets(spark):
    context = spark.sparkContext

    def jobs(sets):
        df = M.materialised(spark.range(900).select((F.col("id") % sets).alias("s"), "id", (F.col("id") % 7).cast("double").alias("x"), (F.xxhash64("id") % 2 == 0).cast("int").alias("y"), (F.col("id") % 5 < 3).alias("t"), F.array(*(((F.col("id") % sets) == k) & (F.col("id") % 5 < 3) for k in range(sets))).alias("flags"), F.array((F.col("id") % 7).cast("int")).alias("bins")))
        context.setJobGroup(f"sets{sets}", "x")
        J.fit_boosted_sets(df.withColumn("y", F.col("y").cast("double")), 1, 7, sets, **TREES)
        n = len(context.statusTracker().getJobIdsForGroup(f"sets{sets}"))
        context.setLocalProperty("spark.jobGroup.id", None)
        return n

    assert jobs(2) == jobs(9)


def test_panel_against_single_metrics(spark):
    rng = np.random.default_rng(5)
    data = [(g, i, int(rng.random() < 0.3), float(np.round(rng.random(), 1))) for g in range(3) for i in range(40 if g else 7)] + [(3, 0, 1, 0.5)]
    df = spark.createDataFrame(data, "g int, k int, y int, p double")
    got = {(r.g, r.metric): r.value for r in R.panel_by_group(df, "g", ["k"], ks=(5, 20), percents=(5, 10)).collect()}
    for g in range(4):
        own = df.where(F.col("g") == g)
        ordered = R.ranked(own, F.col("p"), ["k"], descending=True, total="n")
        want = {"auc": R.roc_auc(own).first()[0], "average_precision": R.average_precision(own).first()[0], "calibration_max_error": R.calibration(own, 10).agg(F.max("error")).first()[0], **R.losses(own).first().asDict()}
        for r in R.at_k(ordered, [5, 20]).collect():
            want |= {f"precision_at_{r.k}": r.precision, f"recall_at_{r.k}": r.recall}
        for r in R.at_percent(ordered, [5, 10]).collect():
            want |= {f"lift_at_{r.percent:g}": r.lift} | ({"top_decile_rate": r.rate} if r.percent == 10 else {})
        for name, value in want.items():
            assert got[g, name] == (value if value is None else pytest.approx(value)), (g, name)
    assert R.panel_by_group(df.limit(0), "g", ["k"]).count() == 0


def test_ranks_in_groups_with_ties_and_nulls(spark):
    data = [("a", 1, None), ("a", 2, 0.5), ("a", 3, 0.5), (None, 4, 0.1), (None, 4, 0.9)]
    got = sorted((str(r.g), r.rn, r.k, r.n) for r in R.ranked_in_groups(spark.createDataFrame(data, "g string, k int, p double"), "g", "p", ["k"]).collect())
    assert got == [("None", 1, 4, 2), ("None", 2, 4, 2), ("a", 1, 2, 3), ("a", 2, 3, 3), ("a", 3, 1, 3)]


def test_report_has_every_section(scored):
    shifts = scored.select("tier").distinct().withColumn("degradation", F.lit(0.1))
    got = L.report(L.metrics(scored), shifts).collect()
    assert {r.section for r in got} == {"seed", "median", "spread", "place", "cohort"}
    seeds = [r.value for r in got if r.section == "seed" and r.tier == "5-LOW" and r.metric == "lr_auc"]
    assert len(seeds) == 5 and next(r.value for r in got if r.section == "median" and r.tier == "5-LOW" and r.metric == "lr_auc") == pytest.approx(np.median(seeds))
    assert sorted(r.value for r in got if r.section == "place" and r.metric == "rate_test") == [1, 2, 3]


def test_cohort_shift_of_every_dataset(spark):
    """The label turns over late in time, so a model of the early rows fails on the late ones and one of random rows doesn't fail as much."""
    df = spark.range(1200).select((F.col("id") % 2).cast("string").alias("t"), F.lit(1).alias("s"), "id", (F.xxhash64("id") % 2 == 0).cast("int").alias("x"))
    df = df.withColumn("y", F.when(F.col("id") < 1020, F.col("x")).otherwise(1 - F.col("x")))
    draw = F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(1000)) / 1000
    got = L.cohort_shifts(df, "t", "s", "id", F.col("id"), ["x"], "y", draw=draw, **TREES).collect()
    assert len(got) == 2 and all(r.cohort_auc == 0.0 and r.random_auc > 0.6 and r.degradation > 0.6 for r in got)


def test_datasets_without_training_rows(spark):
    df = spark.createDataFrame([("a", 1, i, float(i % 3), i % 2, i < 20) for i in range(30)] + [("b", 1, i, 1.0, 1, None) for i in range(4)] + [("b", 1, 9, 1.0, None, True)], "t string, s int, k int, x double, y int, tr boolean")
    got = L.scores(df, "t", "s", "k", ["x"], "y", F.col("tr"), **TREES).collect()
    assert {(r.model, r.p) for r in got if r.tier == "b"} == {("lr", 0.5), ("gbt", 0.5)} and len(got) == 28


def test_gates_are_read(spark):
    text = "per_tier:\n  intro:\n    lr_auc: {min: 0.85, max: 0.95}\ncross_seed_spread:\n  lr_auc: {max: 0.04}\ncohort_shift:\n  auc_degradation: {max: 0.2}\ncross_tier_required: [intro, advanced]\nleakage_probes:\n  id_only_max_auc: 0.6\n  feature_subsets:\n    late: {max_auc: 0.7, columns: [a, b]}\n"
    pytest.importorskip("yaml")
    g = L.load_gates(text)
    assert g == L.Gates((("intro", "lr_auc", 0.85, 0.95),), (("lr_auc", None, 0.04),), (None, 0.2), ("intro", "advanced"), {"late": (0.7, ("a", "b"))}, 0.6, None)


def test_gates_that_raise_and_none():
    assert L.load_gates("{}") == L.Gates()
    for bad in ({"per_tier": {"a": {"m": 1}}}, {"per_tier": {"a": {"m": {}}}}, {"other": {}}, {"cohort_shift": {"least": 1}}, {"leakage_probes": {"feature_subsets": {"x": {"max_auc": 1}}}}, {"leakage_probes": {"feature_subsets": {"x": {"max_auc": 1, "columns": "a"}}}}):
        with pytest.raises(ValueError):
            L.load_gates(json.dumps(bad))


def test_no_gates_no_failures(spark):
    found = spark.createDataFrame([("advanced", 1, "rate_test", 0.2), ("intro", 1, "rate_test", float("nan"))], "tier string, seed long, metric string, value double")
    assert L.failures(found, L.Gates()).collect() == []
    got = L.failures(found, L.Gates(tiers=(("intro", "rate_test", 0.1, None),), required=L.Q.TIERS)).collect()
    assert {(r.gate, r.tier, r.reason) for r in got if r.metric == "rate_test"} == {("tier", "intro", "missing"), ("order", "intro", "undefined against intermediate"), ("order", "intermediate", "undefined against advanced")}


def test_flat_validation(spark):
    got = {r.check: r for r in plans.flat_validation(spark, SF).collect()}
    assert got["baseline_auc"].passed and 0.4 < got["baseline_auc"].found < 0.7
    assert got["leakage_trap:leakage_open"].passed and got["leakage_trap:leakage_open"].found > 0.15
    assert not got["leakage_trap:leakage_faint"].passed and got["columns"].passed
    bad = spark.createDataFrame([(1, 1.0, 2, 0.5), (2, 2.0, 0, 0.1)], "k int, v double, y int, leakage_x double")
    checks = {r.check: r.passed for r in Q.flat_validation(bad, key="k", columns=bad.columns, label="y", value="v", groups=[], auc=(0, 1)).collect()}
    assert not checks["label_binary"] and "baseline_auc" not in checks  # no model of labels that aren't 0 and 1


def test_quantiles_by_group(spark):
    rng = np.random.default_rng(8)
    values = {g: [float(v) for v in rng.integers(0, 6, n)] for g, n in (("a", 31), ("b", 8), (None, 1))}
    df = spark.createDataFrame([(g, v) for g, own in values.items() for v in [*own, None]] + [("none", None)], "g string, v double")
    got = {r.g: r for r in R.quantiles_by_group(df, "g", "v", {"low": 0.1, "median": 0.5}).collect()}
    assert set(got) == set(values)
    for g, own in values.items():
        assert (got[g].low, got[g].median) == pytest.approx((np.quantile(own, 0.1), np.median(own)))


def test_bundles_are_judged(spark, tmp_path):
    """Two tiers of two seeds as bundles write them; one tier has a column of its own."""
    folders = {}
    for tier, noise in (("intro", 10), ("advanced", 60)):
        for seed in (1, 2):
            u = lambda name, seed=seed, tier=tier: F.pmod(F.xxhash64(F.lit(tier), F.lit(seed), F.lit(name), "k"), F.lit(100))
            df = spark.range(300).withColumnRenamed("id", "k").withColumn("x", u("x").cast("double")).withColumn("y", F.when(u("flip") < noise, u("coin") < 50).otherwise(F.col("x") > 60).cast("boolean"))
            df = df.withColumn("at", F.timestamp_seconds(F.col("k") * 3600)).withColumn("own", F.lit("a")) if tier == "intro" else df.withColumn("at", F.timestamp_seconds(F.col("k") * 3600))
            folders.setdefault(tier, {})[seed] = f"{tmp_path}/{tier}{seed}"
            bundle.write_splits(df, folders[tier][seed], "t", "k", 42, 1)
    gates = L.load_gates(json.dumps({"per_tier": {"intro": {"lr_auc": {"min": 0.8}, "gbt_auc": {"min": 0.8}}, "advanced": {"lr_auc": {"min": 0.99}}}, "cross_seed_spread": {"lr_auc": {"max": 0.5}}, "cohort_shift": {"auc_degradation": {"max": 0.5}}, "leakage_probes": {"id_only_max_auc": 0.9, "label_drift_max": 0.0001, "feature_subsets": {"x": {"max_auc": 0.7, "columns": ["x"]}}}}))
    told, failed = L.judged(spark, folders, gates, task="t", key="k", label="y", time="at", **TREES)
    assert {r.section for r in told.collect()} == {"seed", "median", "spread", "place", "cohort"}
    got = {(r.gate, r.tier, r.metric, r.reason) for r in failed.collect()}
    assert ("tier", "advanced", "lr_auc", "below") in got and ("leakage", "intro", "lr:x_auc", "above") in got and ("leakage", "intro", "label_drift", "above") in got
    assert not any(g in ("spread", "cohort") or (g, t) == ("tier", "intro") or m == "lr:id_only_auc" for g, t, m, _ in got)
    late = L.judged(spark, {"intro": {1: folders["intro"][1]}}, L.Gates(cohort=(None, 0.5)), task="t", key="k", label="y", **TREES)[1].collect()
    assert [(r.gate, r.reason) for r in late] == [("cohort", "missing")]  # no time, no shift
    with pytest.raises(ValueError, match="not in all bundles"):
        L.judged(spark, folders, L.Gates(subsets={"o": (0.7, ("own",))}), task="t", key="k", label="y")


def test_shifts_cost_no_linear_models_and_boosted_trees_see_equal_rows_once(spark, monkeypatch):
    """Passes of boosted trees read no more than a row for each dataset, kind and combination of bins; linear models that no AUC needs aren't fitted."""

    def none(*_, **__):
        raise AssertionError("a linear model")

    seen, put = [], J.packed
    monkeypatch.setattr(J, "fit", none)
    monkeypatch.setattr(J, "fit_sets", none)
    monkeypatch.setattr(J, "packed", lambda rows, *a: (seen.append(rows.count()), put(rows, *a))[1])
    df = spark.range(4000).select((F.col("id") % 2).cast("string").alias("t"), F.lit(1).alias("s"), "id", (F.xxhash64("id") % 3).cast("int").alias("x"), (F.xxhash64("id", F.lit(1)) % 2 == 0).cast("int").alias("y"))
    got = L.cohort_shifts(df, "t", "s", "id", F.col("id"), ["x"], "y", draw=F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(1000)) / 1000, **TREES).collect()
    assert len(got) == 2 and len(seen) == 1 and seen[0] <= 2 * 2 * 2 * 5  # sets, kinds, in the other kind's training rows or not, values of x


def test_only_linear_models_rows_are_ranked(spark, scored, monkeypatch):
    ranked, panel = [], R.panel_by_group
    monkeypatch.setattr(R, "panel_by_group", lambda rows, *a, **b: (ranked.append({r[0] for r in rows.select("model").distinct().collect()}), panel(rows, *a, **b))[1])
    got = {(r.tier, r.seed, r.metric): r.value for r in L.metrics(scored).collect()}
    assert ranked == [{"lr"}]
    for model in ("gbt", "lr:month"):
        own = scored.where((F.col("model") == model) & (F.col("tier") == "5-LOW") & (F.col("seed") == 3)).withColumn("p", F.round("p", 12))
        assert got["5-LOW", 3, f"{model}_auc"] == pytest.approx(R.roc_auc(own).first()[0]) and got["5-LOW", 3, f"{model}_average_precision"] == pytest.approx(R.average_precision(own).first()[0])


def test_features_may_have_any_name(spark):
    """Also those that scores() uses itself."""
    df = spark.range(60).select(F.lit("a").alias("t"), F.lit(1).alias("s"), F.col("id").alias("k"), (F.col("id") % 3).alias("bins"), (F.col("id") % 5).alias("x"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") < 40).alias("tr"))
    got = L.scores(df, "t", "s", "k", ["bins", "x"], "y", F.col("tr"), subsets={"own": ["x"]}, **TREES).collect()
    assert len(got) == 60 and {r.model for r in got} == {"lr", "lr:own", "gbt"}
