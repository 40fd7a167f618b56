"""Bootstraps of metrics that need an order: ROC AUC and average precision over resamples, with one range partitioning of the rows instead of one sort a resample.

Rows are dealt once into parts by falling score and sorted there. Each part is streamed twice, all resamples at a time: first for its sums of weights, then, knowing the sums of all rows above it, for its share of the metrics.
Runs of equal scores may reach over several parts, so that one score with most of the rows is no task's.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialised
from .sampling import POISSON_1

#: Weights (rows times resamples) that a task holds at a time.
AT_ONCE = 1_000_000
_LIMITS = np.array([int(x, 16) for x in POISSON_1], np.uint32)
#: The quantiles that are told of a metric's resamples.
SUMMARY = {"low": 0.025, "q25": 0.25, "median": 0.5, "q75": 0.75, "high": 0.975}


#: MD5's constants; blocks that are digested at a time, so that they stay in the cache.
_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
BLOCKS = 16_384


def _digests(blocks: np.ndarray) -> np.ndarray:
    """(n, 4): the MD5 of n padded blocks of 64 bytes, as its four words, all blocks in step."""
    words = np.ascontiguousarray(blocks.view("<u4").T)
    a, b, c, d = (np.full(len(blocks), x, np.uint32) for x in _START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += words[g]
        f += np.uint32(_SINES[i])
        a, d, c, b = d, c, b, b + ((f << np.uint32(_TURNS[i])) | (f >> np.uint32(32 - _TURNS[i])))
    return np.stack([x + np.uint32(x0) for x, x0 in zip((a, b, c, d), _START, strict=True)], 1)


def _draws(seed: int, keys: Sequence[bytes], tails: Sequence[bytes]) -> np.ndarray:
    """(keys, tails, 4): the MD5 of ``<seed>:bootstrap:<key>:<tail>`` as numbers of 32 bits, for keys of one length and tails of one length."""
    head, n, m = f"{seed}:bootstrap:".encode(), len(keys[0]), len(tails[0])
    size = len(head) + n + 1 + m
    if size > 55:  # of more than one block
        return np.frombuffer(b"".join(hashlib.md5(head + k + b":" + t).digest() for k in keys for t in tails), ">u4").reshape(len(keys), len(tails), 4)
    blocks = np.zeros((len(keys), len(tails), 64), np.uint8)
    blocks[..., : len(head)] = np.frombuffer(head, np.uint8)
    blocks[..., len(head) : len(head) + n] = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), 1, n)
    blocks[..., size - m - 1] = ord(":")
    blocks[..., size - m : size] = np.frombuffer(b"".join(tails), np.uint8).reshape(len(tails), m)
    blocks[..., size] = 0x80
    blocks[..., 56:58] = (8 * size & 255, 8 * size >> 8)
    flat = blocks.reshape(-1, 64)
    out = np.concatenate([_digests(flat[at : at + BLOCKS]) for at in range(0, len(flat), BLOCKS)])
    return out.byteswap().reshape(len(keys), len(tails), 4)


def weights(seed: int, keys: Sequence[str], replicates: int) -> np.ndarray:
    """(keys, replicates): Poisson(1) counts, the same as those of sampling.bootstrap()."""
    coded, tails = [k.encode() for k in keys], [str(b).encode() for b in range(-(-replicates // 4))]
    draws = np.empty((len(keys), len(tails), 4), np.uint32)
    sizes = np.array([len(k) for k in coded])
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        some, at = [coded[i] for i in own], 0
        for m in range(1, len(tails[-1]) + 1) if tails else ():
            of = [t for t in tails if len(t) == m]
            draws[own, at : at + len(of)] = _draws(seed, some, of)
            at += len(of)
    return np.searchsorted(_LIMITS, draws.reshape(len(keys), -1)[:, :replicates], "right")


def _runs(batches: Iterator[pa.RecordBatch], seed: int, replicates: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(scores, pos, neg, last) of a part's runs of equal scores, some at a time: sums of weights of each run and resample. The part's last run comes by itself."""
    open_run = None
    step = max(1, AT_ONCE // replicates)
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            scores, y = (batch.column(name).to_numpy() for name in ("score", "y"))
            w = weights(seed, batch.column("key").to_pylist(), replicates)
            heads = np.flatnonzero(np.r_[True, scores[1:] != scores[:-1]])
            pos, every, scores = np.add.reduceat(w * y[:, None], heads), np.add.reduceat(w, heads), scores[heads]
            neg = every - pos
            if open_run is not None and open_run[0] == scores[0]:
                pos[0] += open_run[1]
                neg[0] += open_run[2]
            elif open_run is not None:
                scores, pos, neg = np.r_[open_run[0], scores], np.vstack([open_run[1], pos]), np.vstack([open_run[2], neg])
            open_run = scores[-1], pos[-1], neg[-1]
            if len(scores) > 1:
                yield scores[:-1], pos[:-1], neg[:-1], False
    if open_run is not None:
        yield np.array([open_run[0]]), open_run[1][None], open_run[2][None], True


def _sums(seed: int, replicates: int):
    """(at, score, inner, replicate, pos, neg) of a part's first run, of all between, and of its last run, in order; the middle has no score but the part as ``inner``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last = None, None, None
        inner, held = np.zeros((2, replicates), np.int64), 0

        def noted():
            nonlocal part
            for batch in batches:
                if part is None and batch.num_rows:
                    part = batch.column("part")[0].as_py()
                yield batch

        for scores, pos, neg, final in _runs(noted(), seed, replicates):
            if first is None:
                first, scores, pos, neg = (scores[0], pos[0], neg[0]), scores[1:], pos[1:], neg[1:]
            if final and len(scores):
                last = scores[0], pos[0], neg[0]
            elif not final:
                inner += pos.sum(0), neg.sum(0)
                held += len(scores)
        found = [] if first is None else [(0, *first)]
        found += [(1, None, *inner)] if held else []
        found += [(2, *last)] if last else []
        for place, score, pos, neg in found:
            columns = (
                pa.array(np.full(replicates, 3 * part + place)), pa.array([score] * replicates, pa.float64()), pa.array([part if score is None else None] * replicates, pa.int64()),
                pa.array(np.arange(replicates, dtype=np.int32)), pa.array(pos), pa.array(neg),
            )
            yield pa.RecordBatch.from_arrays(list(columns), names=["at", "score", "inner", "replicate", "pos", "neg"])

    return run


def _shares(seed: int, replicates: int):
    """(replicate, area, steps) of what lies between a part's first and last run; the part's first row has the sums above that, in order of the resamples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = None

        def noted():
            nonlocal above
            for batch in batches:
                if above is None and batch.num_rows:
                    held = batch.column("above")[0]
                    if held.as_py() is None:  # nothing between
                        return
                    above = [np.asarray(held.values.field(side).to_numpy()) for side in ("pos", "neg")]
                yield batch

        area, steps, begun = np.zeros(replicates), np.zeros(replicates), False
        for _, pos, neg, final in _runs(noted(), seed, replicates):
            if not begun:
                begun, pos, neg = True, pos[1:], neg[1:]
            if final or not len(pos):
                continue
            p, n = above[0] + np.cumsum(pos, 0), above[1] + np.cumsum(neg, 0)
            area += (neg * (p - pos / 2)).sum(0)
            steps += (pos * (p / np.maximum(p + n, 1))).sum(0)
            above = [p[-1], n[-1]]
        if above is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates, dtype=np.int32)), pa.array(area), pa.array(steps)], names=["replicate", "area", "steps"])

    return run


def rank_replicates(df: DataFrame, key: str, score: Column, label: Column, *, replicates: int = 200, seed: int, parts: int | None = None) -> DataFrame:
    """(replicate, auc, average_precision) of resamples with replacement of df's rows; null in a resample of one class only.

    A row's weight in a resample is a Poisson(1) draw of its key, as in sampling.bootstrap(): rows of one key are drawn together. Ties count half in the AUC and are one step in the average precision.
    Rows without a key, a finite score or a label of 0 or 1 take no part; without rows there are no replicates. Memory is AT_ONCE weights a task; what is shuffled beside the rows themselves is three rows
    for each part and resample, and a part is told the sums above it by a broadcast of one row for each part.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).cast("string").alias("key"), (score.cast("double") + F.lit(0.0)).alias("score"), label.cast("long").alias("y"))
    rows = rows.where(F.col("key").isNotNull() & (F.abs("score") < float("inf")) & F.col("y").isin(0, 1))  # NaN is above infinity
    # Keys cut a score's rows into parts too.
    dealt = rows.withColumn("tie", F.xxhash64("key")).repartitionByRange(n, F.desc("score"), "tie").sortWithinPartitions(F.desc("score"), "tie")
    place = F.monotonically_increasing_id()
    dealt = materialised(dealt.select("key", "score", "y", F.spark_partition_id().cast("long").alias("part"), (place.bitwiseAND(F.lit((1 << 33) - 1)) == 0).alias("head")))
    sums = materialised(dealt.mapInArrow(_sums(seed, replicates), "at long, score double, inner long, replicate int, pos long, neg long"))
    # Runs that reach over several parts are one.
    merged = sums.groupBy("replicate", "score", "inner").agg(F.min("at").alias("at"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    until = Window.partitionBy("replicate").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # of at most three rows a part
    merged = merged.withColumns({f"{c}_above": F.coalesce(F.sum(c).over(until), F.lit(0)) for c in ("pos", "neg")})
    told = merged.where(F.col("inner").isNotNull()).groupBy(F.col("inner").alias("part")).agg(F.sort_array(F.collect_list(F.struct("replicate", F.col("pos_above").alias("pos"), F.col("neg_above").alias("neg")))).alias("above"))
    led = dealt.join(F.broadcast(told.withColumn("head", F.lit(True))), ["part", "head"], "left").select("key", "score", "y", "above")
    inside = led.mapInArrow(_shares(seed, replicates), "replicate int, area double, steps double")
    p = (F.col("pos_above") + F.col("pos")).cast("double")
    ends = merged.where(F.col("inner").isNull()).select(
        "replicate", (F.col("neg") * (p - F.col("pos") / 2)).alias("area"), F.coalesce(F.col("pos") * F.try_divide(p, p + F.col("neg_above") + F.col("neg")), F.lit(0.0)).alias("steps")
    )
    got = inside.unionByName(ends).groupBy("replicate").agg(F.sum("area").alias("area"), F.sum("steps").alias("steps"))
    all_of = sums.groupBy("replicate").agg(F.sum("pos").cast("double").alias("pos"), F.sum("neg").cast("double").alias("neg"))
    both = F.col("pos") * F.col("neg")
    return got.join(all_of, "replicate").select("replicate", F.try_divide("area", both).alias("auc"), F.when(both > 0, F.try_divide("steps", F.col("pos"))).alias("average_precision"))


def bootstrap_ranked(df: DataFrame, key: str, scores: Sequence[str], label: str, *, replicates: int = 200, seed: int, parts: int | None = None) -> DataFrame:
    """(score, metric, replicates, low, q25, median, q75, high) of each score's AUC and average precision over the same resamples, and of differences from the first score; replicates: how many have both classes.

    A difference has ``score`` like ``b - a``. All quantiles are null without replicates.
    """
    each = {s: rank_replicates(df, key, F.col(s), F.col(label), replicates=replicates, seed=seed, parts=parts) for s in scores}
    first = scores[0]
    base = each[first] = materialised(each[first])
    for s in scores[1:]:
        each[s] = materialised(each[s])
        one, other = each[s].alias("one"), base.alias("other")
        each[f"{s} - {first}"] = one.join(other, "replicate").select("replicate", *((F.col(f"one.{m}") - F.col(f"other.{m}")).alias(m) for m in ("auc", "average_precision")))
    out = None
    for name, rows in each.items():
        made = [F.struct(F.lit(name).alias("score"), F.lit(m).alias("metric"), F.count(m).alias("replicates"), *(F.percentile(m, q).alias(c) for c, q in SUMMARY.items())) for m in ("auc", "average_precision")]
        one = rows.agg(F.array(*made).alias("r")).select(F.explode("r").alias("r")).select("r.*")
        out = one if out is None else out.unionByName(one)
    return out
