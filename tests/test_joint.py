"""Models that are fitted together against plain numpy and against separate fits."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tallyrand.operators import joint as J
from tallyrand.operators import models as M
from tallyrand.operators import ranking as R
from tallyrand.plans import worlds


def made(n=900, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    terms = [sorted(rng.choice(12, rng.integers(0, 5), replace=False).tolist()) for _ in range(n)]
    y = (x[:, 0] - 0.5 * x[:, 2] + [1.5 * (3 in t) - (7 in t) for t in terms] + rng.logistic(size=n) > 0).astype(float)
    flags = rng.random((n, 3)) < 0.7
    return x, terms, y, flags


def frame(spark, x, terms, y, flags, parts=5):
    rows = [(i, float(y[i]), flags[i].tolist(), x[i].tolist(), terms[i]) for i in range(len(y))]
    return spark.createDataFrame(rows, "id int, y double, flags array<boolean>, x array<double>, terms array<int>").repartition(parts, "id").sortWithinPartitions("id")


PROBLEMS = [J.Problem(0), J.Problem(1), J.Problem(2, (0, 3, 12, 14)), J.Problem(2)]
SHAPE = J.Shape(12, 4, np.linspace(0.5, 2, 16))


def plain(x, terms, y, flags, **options):
    """The same problems over one matrix."""
    wide = np.zeros((len(y), 16))
    for i, t in enumerate(terms):
        wide[i, t] = 1
    wide[:, 12:] = x
    wide = np.hstack([wide * SHAPE.scale, np.ones((len(y), 1))])

    def evaluate(weights, which):
        out = []
        for w, k in zip(weights, which, strict=True):
            use = flags[:, PROBLEMS[k].flag]
            z = wide[use] @ w
            p = 1 / (1 + np.exp(-z))
            out.append([np.logaddexp(0, z).sum() - y[use] @ z, use.sum(), *(wide[use].T @ (p - y[use]))])
        return np.array(out)

    return evaluate, J.minimised(evaluate, PROBLEMS, 17, **options)


@pytest.mark.parametrize("options", [{"l2": 0.01}, {"l1": 0.02, "steps": 60}, {}])
def test_joint_fit_against_numpy(spark, monkeypatch, options):
    monkeypatch.setattr(J, "DIRECT", 2)  # vectors are added on the executors first
    data = made()
    _, want = plain(*data, tolerance=1e-12, **options)
    rows = M.materialised(frame(spark, *data))
    got = J.fit(rows, SHAPE, PROBLEMS, tolerance=1e-12, **options)
    assert np.abs(got - want).max() < 1e-6
    p = {r.id: r.p for r in J.predicted(rows, SHAPE, got, ["id"]).collect()}
    x, terms, _, _ = data
    for i in (0, 17, 899):
        z = sum(got[1][t] * SHAPE.scale[t] for t in terms[i]) + (x[i] * SHAPE.scale[12:]) @ got[1][12:16] + got[1][16]
        assert math.isclose(p[i][1], 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_minimum_is_one(spark):
    """At the end no weight's penalised gradient points down, and features that a problem doesn't see weigh nothing."""
    for options in ({"l2": 0.01}, {"l1": 0.02, "steps": 200}):
        data = made()
        evaluate, w = plain(*data, tolerance=1e-14, **options)
        found = evaluate(w, list(range(4)))
        for k, row in enumerate(found):
            g = row[2:] / row[1]
            free = np.zeros(17, bool)
            free[[*(PROBLEMS[k].features or range(16)), 16]] = True
            l1, l2 = options.get("l1", 0.0), options.get("l2", 0.0)
            g[:-1] += l2 * w[k][:-1]
            zero = np.append(w[k][:-1] == 0, False)
            slack = np.where(zero, np.maximum(np.abs(g) - l1, 0), np.abs(g + np.append(l1 * np.sign(w[k][:-1]), 0)))
            assert slack[free].max() < 1e-4
            assert not w[k][~free].any()


def test_no_rows_and_one_class(spark):
    x, terms, y, flags = made(60)
    rows = M.materialised(frame(spark, x, terms, np.ones(60), flags))
    assert np.isfinite(J.fit(rows, SHAPE, PROBLEMS, l2=0.1)).all()
    assert not J.fit(rows.limit(0), SHAPE, PROBLEMS, l2=0.1).any()
    assert J.predicted(rows.limit(0), SHAPE, np.zeros((4, 17)), ["id"]).collect() == []


def test_hold_outs_are_exact(spark):
    df = spark.range(5000).withColumn("y", F.when(F.col("id") % 10 == 0, 1).when(F.col("id") % 1000 == 7, None).otherwise(0))
    rows = M.hold_outs(df, "id", "y", [1, 2, 3], 0.3).collect()
    assert len(rows) == 5000
    for s in range(3):
        assert sum(r.test[s] for r in rows if r.y == 1) == 150
        assert sum(r.test[s] for r in rows if r.y == 0) == round(0.3 * sum(r.y == 0 for r in rows))
    assert not any(any(r.test) for r in rows if r.y is None)
    assert len({tuple(r.id for r in rows if r.test[s]) for s in range(3)}) == 3


def test_metrics_by_group_against_single_ones(spark):
    rng = random.Random(3)
    data = [(g, rng.randint(0, 1) if g else 1, round(rng.random(), 2)) for g in range(4) for _ in range(200)]
    df = spark.createDataFrame(data, "g int, y int, p double")
    got = {r.g: r for r in R.metrics_by_group(df, "g").collect()}
    for g in range(4):
        own = df.where(F.col("g") == g)
        auc, ap = R.roc_auc(own).first()[0], R.average_precision(own).first()[0]
        assert got[g].auc == (auc if auc is None else pytest.approx(auc)) and got[g].average_precision == pytest.approx(ap)
    assert got[0].auc is None and got[0].n_pos == 200


def test_trap_delta_against_separate_fits(spark):
    """Within 1e-3 of a pyspark.ml pipeline fitted for each seed and feature set on the same rows, in 60 jobs at most."""
    from pyspark.sql.functions import col

    df = worlds._orders(spark, SF)
    df = M.materialised(df.withColumn("leak", col("y") + F.pmod(F.xxhash64("o_orderkey"), F.lit(3))))
    context = spark.sparkContext
    context.setJobGroup("trap", "trap")
    deltas = M.trap_delta(df, "o_orderkey", ["o_totalprice", "month", "o_orderpriority"], "leak", "y")
    jobs = len(context.statusTracker().getJobIdsForGroup("trap"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 60, jobs
    got = {r.seed: r for r in deltas.collect()}
    rows = M.hold_outs(df, "o_orderkey", "y", list(range(1, 11)), 0.3)
    for s in (0, 9):
        for name, more in (("auc_with", ["leak"]), ("auc_without", [])):
            one = M.fit_predict(rows.where(~F.col("test")[s]), rows.where(F.col("test")[s]), ["o_totalprice", "month", "o_orderpriority", *more], "y", "lr")
            assert abs(got[s + 1][name] - M.auc_of(one)) < 1e-3
    assert all(r.delta > 0.1 for r in got.values())
    assert M.trap_verdicts(deltas, 0.05, 0.02).first().ok and not M.trap_verdicts(deltas, 0.9, 0.02).first().ok


def test_boosted_trees_against_numpy(spark):
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 9, (700, 3))  # 8 stands for missing
    y = ((bins[:, 0] > 3) ^ (bins[:, 1] == 8)).astype(float)
    y = np.where(rng.random(700) < 0.1, 1 - y, y)
    rows = M.materialised(spark.createDataFrame([(float(a), b.tolist()) for a, b in zip(y, bins, strict=True)], "y double, bins array<int>").repartition(4))
    got = J.fit_boosted(rows, 3, 8, trees=6)
    want = J.boost(lambda model, tree, level: J.histograms(model, tree, level)(bins, y), 3, 8, y.mean(), trees=6)
    for a, b in zip(got.trees, want.trees, strict=True):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and (a.left == b.left).all()
        assert np.abs(a.values - b.values).max() < 1e-9
    loss = lambda z: (np.logaddexp(0, z) - y * z).mean()
    assert loss(want.margin(bins)) < 0.7 * loss(np.zeros(700))
    p = sorted(r.p for r in J.predict_boosted(rows, got, ["y"]).collect())
    assert np.abs(np.array(p) - np.sort(1 / (1 + np.exp(-want.margin(bins))))).max() < 1e-9


def test_split_by_trying_all():
    rng = np.random.default_rng(2)
    g, h = rng.normal(size=(2, 3, 6)), rng.random((2, 3, 6)) * 4
    g[:, 1:], h[:, 1:] = g[:, 1:] * (g[:, :1].sum(2) / g[:, 1:].sum(2))[:, :, None], h[:, 1:] * (h[:, :1].sum(2) / h[:, 1:].sum(2))[:, :, None]
    feature, cut, left, children = J.best_splits(g, h, 1.0, 0.5)
    for n in range(2):
        best = (1e-9, -1)
        for f in range(3):
            for c in range(4):
                for side in (False, True):
                    a, b = g[n, f, : c + 1].sum() + side * g[n, f, -1], h[n, f, : c + 1].sum() + side * h[n, f, -1]
                    tg, th = g[n, 0].sum(), h[n, 0].sum()
                    if b >= 0.5 and th - b >= 0.5:
                        gain = a * a / (b + 1) + (tg - a) ** 2 / (th - b + 1) - tg * tg / (th + 1)
                        best = max(best, (gain, f, c, side, a, b))
        assert (feature[n], cut[n], left[n]) == best[1:4] and np.allclose(children[n, 0], best[4:])


def test_missing_values_find_their_side(spark):
    df = spark.range(1200).select("id", F.when(F.col("id") % 3 != 0, (F.col("id") % 50).cast("double")).alias("x"), F.when(F.col("id") % 5 == 0, None).otherwise(F.when(F.col("id") % 2 == 0, "a").otherwise("b")).alias("c"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    train, test = M.held_out(df, "id", 0.3, 1)
    out = M.hist_gbt(train, test, ["x", "c"], "y", ["id"], trees=10)
    assert M.auc_of(out) == 1.0 and out.count() == test.count()
    batch = pa.RecordBatch.from_arrays([pa.array([[1, 2], None, []], pa.list_(pa.int32()))], names=["terms"])
    assert J._lists(batch.column(0), int)[1].tolist() == [0, 2, 2, 2]


def test_bins_are_places_among_the_edges(spark):
    """Every number's bin is how many of its column's quantiles lie below it; categories stand by falling frequency."""
    df = spark.range(400).select("id", F.when(F.col("id") % 10 > 0, F.pmod(F.xxhash64("id"), F.lit(50)).cast("double")).alias("x"), (F.col("id") % 2).alias("b"), F.when(F.col("id") % 9 > 0, F.when(F.col("id") % 4 == 0, "rare").otherwise("often")).alias("c"))
    cuts = [sorted(set(e)) for e in df.approxQuantile(["x", "b"], [i / 8 for i in range(1, 8)], 1e-3)]
    seen = {r.id: r for r in df.collect()}
    for r in M.binned(df, df, ["x", "b"], ["c"], ["id"], bins=8).collect():
        own = seen[r.id]
        assert r.bins == [8 if own.x is None else sum(e < own.x for e in cuts[0]), sum(e < own.b for e in cuts[1]), {"often": 0, "rare": 1, None: 8}[own.c]]


def test_boosted_trees_learn_from_numbers(spark):
    df = spark.range(1000).select("id", F.pmod(F.xxhash64("id"), F.lit(100)).cast("double").alias("x")).withColumn("y", (F.col("x") > 60).cast("int"))
    train, test = M.held_out(df, "id", 0.3, 1)
    assert M.auc_of(M.hist_gbt(train, test, ["x"], "y", ["id"], trees=5)) > 0.99


def test_rows_of_joint_models_are_written_once_with_their_flags(spark, monkeypatch):
    from tallyrand.operators import models

    seen, whole = [], models.materialised
    monkeypatch.setattr(models, "materialised", lambda df, **k: (seen.append(df.columns), whole(df, **k))[1])
    rows = spark.range(200).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    models.cross_validated(rows, "id", ["a"], "y", "lr", folds=2)
    assert len(seen) == 2 and "flags" in seen[1] and "x" in seen[1]


def test_null_lists_are_empty():
    values, ends = J._lists(pa.array([[1.0, 2.0], None, [], [3.0]]).slice(0, 4), np.float64)
    assert values.tolist() == [1.0, 2.0, 3.0] and ends.tolist() == [0, 2, 2, 2, 3]
    assert J._lists(pa.array([], pa.list_(pa.float64())), np.float64)[1].tolist() == [0]


def test_trees_learn_from_bounded_parts(spark, monkeypatch):
    """Parts grew with the table, as their number did not."""
    rows = spark.range(0, 1000, 1, 2).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    seen, whole = [], M.materialised
    monkeypatch.setattr(M, "materialised", lambda df, **k: (seen.append(whole(df, **k)), seen[-1])[1])
    monkeypatch.setattr(M, "TREE_ROWS", 150)
    assert M.fit_predict(rows, rows, ["a"], "y", "gbt", ["id"]).count() == 1000
    sizes = [r["count"] for r in seen[0].groupBy(F.spark_partition_id().alias("part")).count().collect()]
    assert sum(sizes) == 1000 and len(sizes) == 7 and max(sizes) <= 150


def test_held_out_metrics_over_slots(spark, monkeypatch):
    """Many slots and blocks, a slot with one score only, ties, a set without rows and one with one class: as by sorting each problem's scores."""
    monkeypatch.setattr(J, "SLOT", 50)
    monkeypatch.setattr(J, "HELD", 70)
    rng = np.random.default_rng(5)
    x, y = np.round(rng.normal(size=(900, 2)), 2), rng.integers(0, 2, 900)
    test = np.stack([rng.random(900) < 0.4, rng.random(900) < 0.7, np.zeros(900, bool), y == 1], 1)
    rows = spark.createDataFrame([(float(b), t.tolist(), a.tolist()) for a, b, t in zip(x, y, test, strict=True)], "y double, test array<boolean>, x array<double>").repartition(5)
    weights = np.array([[1.5, -0.5, 0.1], [0.3, 0.2, -2.0], [0.0, 0.0, 0.4], [1.0, 1.0, 0.0], [1.0, 0.0, 0.0]])
    sets = [0, 1, 0, 2, 3]
    found = J.held_out_metrics(rows, J.Shape(0, 2, np.array([1.0, 2.0])), weights, sets)
    for w, k, (auc, precision) in zip(weights, sets, found, strict=True):
        p, own = np.round(1 / (1 + np.exp(-(x * [1.0, 2.0] @ w[:2] + w[2]))), 9)[test[:, k]], y[test[:, k]]
        pos, neg = p[own == 1], p[own == 0]
        if not len(pos):
            assert (auc, precision) == (None, None)
            continue
        steps = [((pos == v).sum() / len(pos), (pos >= v).sum() / (p >= v).sum()) for v in np.unique(p)]
        assert precision == pytest.approx(sum(a * b for a, b in steps), abs=1e-12)
        if len(neg):
            assert auc == ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / len(pos) / len(neg)
        else:
            assert auc is None


def test_models_of_sets_against_flags(spark, monkeypatch):
    """Each row in one set, in many small blocks; set 3 has no rows."""
    monkeypatch.setattr(J, "BLOCK", 200)
    monkeypatch.setattr(J, "PACKED", 700)
    x, _, y, _ = made()
    shape, seen = J.Shape(0, 4, np.linspace(0.5, 2, 4)), [None, (0, 3)]
    rows = M.materialised(spark.createDataFrame([(i, i * i % 3, float(y[i]), x[i].tolist(), [i * i % 3 == k for k in range(4)]) for i in range(len(y))], "id int, s int, y double, x array<double>, flags array<boolean>").repartition(3))
    got = J.fit_sets(rows, shape, "s", 4, seen, l2=0.01, tolerance=1e-12)
    want = J.fit(rows, shape, [J.Problem(k, own) for k in range(4) for own in seen], l2=0.01, tolerance=1e-12).reshape(4, 2, 5)
    assert np.abs(got - want).max() < 1e-6 and not got[3].any() and not got[2].any()  # no square leaves 2 over 3
    p = {r.id: (r.s, r.p) for r in J.predicted_sets(rows, shape, got, "s", ["id", "s"]).collect()}
    for r in J.predicted(rows, shape, got.reshape(8, 5), ["id"]).collect():
        assert p[r.id][1] == pytest.approx(r.p[2 * p[r.id][0] : 2 * p[r.id][0] + 2])
    assert not J.fit_sets(rows.limit(0), shape, "s", 2, seen).any()


def test_boosted_trees_learn_from_counts(spark, monkeypatch):
    """Rows of equal bins count once, with their number; sets overlap, and the last one is empty."""
    monkeypatch.setattr(J, "BLOCK", 50)
    rng = np.random.default_rng(7)
    bins, flags = rng.integers(0, 5, (800, 2)), np.c_[rng.random((800, 2)) < 0.6, np.zeros(800, bool)]
    y = ((bins[:, 0] > 2) ^ (rng.random(800) < 0.2)).astype(float)
    rows = spark.createDataFrame([(float(a), f.tolist(), b.tolist()) for a, f, b in zip(y, flags, bins, strict=True)], "y double, flags array<boolean>, bins array<int>").repartition(4)
    assert J.counted(rows.withColumn("s", F.lit(0)), "s").count() <= 25
    got = J.fit_boosted_sets(rows, 2, 4, 3, trees=5)
    assert not got[2].trees
    for k in range(2):
        own = flags[:, k]
        want = J.boost(lambda model, tree, level, own=own: J.histograms(model, tree, level)(bins[own], y[own]), 2, 4, y[own].mean(), trees=5)
        assert np.abs(got[k].margin(bins) - want.margin(bins)).max() < 1e-9


def test_metrics_of_counted_scores(spark):
    rng = random.Random(4)
    data = [(g, rng.randint(0, 1), round(rng.random(), 1)) for g in range(3) for _ in range(100)]
    df = spark.createDataFrame(data, "g int, y int, p double")
    counted = df.groupBy("g", "p").agg(F.sum("y").alias("ones"), F.count("*").alias("n"))
    a, b = ({r.g: r for r in found.collect()} for found in (R.metrics_by_group(df, "g"), R.metrics_by_group(counted, "g", label="ones", count="n")))
    assert all(a[g].n_pos == b[g].n_pos and a[g].n_neg == b[g].n_neg and a[g].auc == pytest.approx(b[g].auc) and a[g].average_precision == pytest.approx(b[g].average_precision) for g in range(3))
