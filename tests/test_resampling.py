"""Bootstraps of ranks against plain resampling with the same weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrand.operators import resampling


def plain(keys, scores, y, replicates, seed):
    """AUC and average precision of each resample, by sorting it."""
    w = resampling.weights(seed, [str(k) for k in keys], replicates)
    out = []
    for r in range(replicates):
        by = {}
        for s, label, n in zip(scores, y, w[:, r], strict=True):
            by.setdefault(s, [0, 0])[label] += int(n)
        p = n = area = steps = 0
        for s in sorted(by, reverse=True):
            neg, pos = by[s]
            p, n = p + pos, n + neg
            area += neg * (p - pos / 2)
            steps += pos * p / max(p + n, 1)
        out.append((area / (p * n), steps / p) if p * n else (None, None))
    return out


@pytest.mark.parametrize("kind", ["distinct", "tied", "one score", "two rows"])
def test_replicates_are_those_of_sorted_resamples(spark, kind, monkeypatch):
    monkeypatch.setattr(resampling, "AT_ONCE", 7 * 30)  # several pieces a part
    rng = np.random.default_rng(3)
    n = 2 if kind == "two rows" else 400
    scores = {"distinct": rng.random(n), "tied": rng.choice([0.1, 0.5, 0.5, 0.5, 0.9, 0.95], n), "one score": np.full(n, 0.25), "two rows": np.array([0.3, 0.4])}[kind]
    y = (rng.random(n) < 0.2 + 0.5 * scores).astype(int)
    df = spark.createDataFrame([(i, float(s), int(v)) for i, (s, v) in enumerate(zip(scores, y, strict=True))], "id long, s double, y int")
    got = {r.replicate: (r.auc, r.average_precision) for r in resampling.rank_replicates(df, "id", F.col("s"), F.col("y"), replicates=30, seed=5, parts=6).collect()}
    want = plain(range(n), scores.tolist(), y.tolist(), 30, 5)
    assert sorted(got) == list(range(30))
    for r, pair in enumerate(want):
        assert got[r] == (pytest.approx(pair) if pair[0] is not None else pair), (kind, r)


def test_rows_that_take_no_part_and_empty_tables(spark):
    rows = [(1, 0.2, 0), (2, 0.8, 1), (3, 0.5, 0), (4, 0.6, 1), (5, 0.4, 1)]
    odd = [(None, 0.5, 1), (7, None, 1), (8, float("nan"), 0), (9, float("inf"), 1), (10, 0.1, None), (11, 0.1, 2)]
    schema = "id long, s double, y int"
    runs = [sorted(map(tuple, resampling.rank_replicates(spark.createDataFrame(r, schema), "id", F.col("s"), F.col("y"), replicates=9, seed=1).collect())) for r in (rows, rows + odd)]
    assert runs[0] == runs[1] and len(runs[0]) == 9
    none = resampling.bootstrap_ranked(spark.createDataFrame([], schema), "id", ["s"], "y", replicates=9, seed=1).collect()
    assert [(r.metric, r.replicates, r.median) for r in none] == [("auc", 0, None), ("average_precision", 0, None)]


def test_a_hot_score_is_in_several_parts(spark):
    """Half of all rows have one score; no part has more than about its share of the rows."""
    df = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, 0.5).otherwise(F.col("id") / 4000).alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    tied = df.withColumn("tie", F.xxhash64(F.col("id").cast("string"))).repartitionByRange(8, F.desc("s"), "tie")
    sizes = [r["count"] for r in tied.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 4000 / 4
    got = resampling.rank_replicates(df, "id", F.col("s"), F.col("y"), replicates=8, seed=2, parts=8).collect()
    rows = df.collect()
    want = plain([r.id for r in rows], [r.s for r in rows], [r.y for r in rows], 8, 2)
    assert {r.replicate: pytest.approx((r.auc, r.average_precision)) for r in got} == dict(enumerate(want))


def test_differences_are_paired(spark):
    df = spark.range(300).select("id", (F.col("id") % 37 / 37.0).alias("a"), (F.col("id") % 11 / 11.0).alias("b"), (F.col("id") % 5 < 2).cast("int").alias("y"))
    out = {(r.score, r.metric): r for r in resampling.bootstrap_ranked(df, "id", ["a", "b"], "y", replicates=24, seed=4).collect()}
    assert set(s for s, _ in out) == {"a", "b", "b - a"}
    per = {s: {r.replicate: r.auc for r in resampling.rank_replicates(df, "id", F.col(s), F.col("y"), replicates=24, seed=4).collect()} for s in "ab"}
    assert out["b - a", "auc"].median == pytest.approx(np.median([per["b"][r] - per["a"][r] for r in per["a"]]))
    assert out["a", "auc"].low <= out["a", "auc"].q25 <= out["a", "auc"].median <= out["a", "auc"].q75 <= out["a", "auc"].high


def test_draws_are_digested_together():
    """All keys of one length share the steps of MD5; long keys, of more than one block, are digested one by one."""
    import hashlib

    keys = ["", "7", "é", "12", "34", "a" * 43, "b" * 36, "x" * 60]
    got = resampling.weights(-3, keys, 403)
    plain = np.array([[int(hashlib.md5(f"-3:bootstrap:{k}:{r // 4}".encode()).hexdigest()[8 * (r % 4) :][:8], 16) for r in range(403)] for k in keys])
    assert (got == np.searchsorted(resampling._LIMITS, plain.astype(np.uint32), "right")).all()
    blocks = np.zeros((1, 64), np.uint8)
    blocks[0, 0] = 0x80
    assert resampling._digests(blocks).tobytes() == hashlib.md5(b"").digest()
