"""Splits, samples, missing values and distortions, all by counter-based draws, so that the same seed gives the same rows anywhere."""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.random import fast_uniform, normal, poisson, uniform
from ..functions.scalars import band, clipped, mapped
from .ranking import quantiles, ranked

#: Rows of a class that stratified() takes by sorting.
TOP_ROWS = 10_000


def exact_splits(df: DataFrame, key: str, *, seed: int, shares: Sequence[tuple[str, float]] = (("train", 0.7), ("valid", 0.15)), rest: str = "test") -> DataFrame:
    """df with ``split``: rows in hashed order, the first int(n * share) to the first split and so on, the remainder to ``rest``."""
    rows = ranked(df, uniform(seed, "split", F.col(key)), [key], total="_n")
    out, end = F.lit(rest), None
    ends = []
    for name, share in shares:
        end = F.floor(F.col("_n") * share) + (0 if end is None else end)
        ends.append((name, end))
    for name, end in reversed(ends):
        out = F.when(F.col("rn") <= end, name).otherwise(out)
    return rows.withColumn("split", out).drop("rn", "_n")


def hashed_splits(df: DataFrame, key: str, *, seed: int, shares: Sequence[tuple[str, float]] = (("train", 0.7), ("valid", 0.15)), rest: str = "test") -> DataFrame:
    """As exact_splits() but by thresholds on the draw: no shuffle at all, with sizes that are right on average."""
    u, end = uniform(seed, "split", F.col(key)), 0.0
    out, bounds = F.lit(rest), []
    for name, share in shares:
        end += share
        bounds.append((name, end))
    for name, end in reversed(bounds):
        out = F.when(u < end, name).otherwise(out)
    return df.withColumn("split", out)


def stratified(df: DataFrame, key: str, label: str, n: int, rate: float, *, seed: int, refill: bool = False) -> DataFrame:
    """n rows, of which round(n * rate) have label 1: those with the lowest draws. Raises if a class has too few; with ``refill`` negatives stand in for missing positives, and where these too are short there are fewer rows.

    Each class is a top-n, which keeps n rows per task at most; of more than TOP_ROWS rows, which would meet in one task, it is what lies up to a bound that counts of the draws give.
    df is read several times.
    """
    positives = int(n * rate + 0.5)
    counts = {r[label]: r["count"] for r in df.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    if refill:
        positives = min(positives, counts.get(1, 0))
    wanted = {1: positives, 0: min(n - positives, counts.get(0, 0)) if refill else n - positives}
    short = {k: (counts.get(k, 0), v) for k, v in wanted.items() if counts.get(k, 0) < v}
    if short:
        raise ValueError(f"too few rows (there are, wanted) by class: {short}")
    rows = df.withColumn("_u", uniform(seed, "subsample", F.col(key)))
    picked = [rows.where(F.col(label) == k).orderBy("_u", key).limit(v) if v <= TOP_ROWS else lowest(rows.where(F.col(label) == k), "_u", key, v, counts[k]) for k, v in wanted.items()]
    return picked[0].unionByName(picked[1]).drop("_u")


def lowest(df: DataFrame, u: str, key: str, n: int, size: int) -> DataFrame:
    """The n rows of df, which has ``size``, that come first by ``u``, in [0, 1), and then by key. Nothing but counts is shuffled: of bins of u, then of the pairs (u, key) in the one bin in which the last row lies."""
    bits = min(20, max(4, size.bit_length() - 10))
    own = df.select(u, key, F.floor(F.col(u) * (1 << bits)).alias("_bin"))

    def reached(counts: DataFrame, by: Sequence[str], n: int):
        until = F.sum("n").over(Window.orderBy(*by))  # of 2^bits bins, or the pairs of one
        return counts.withColumn("until", until).where(F.col("until") >= n).orderBy("until").first()

    b = reached(own.groupBy("_bin").agg(F.count("*").alias("n")), ["_bin"], n)
    inside = n - b["until"] + b["n"]
    last = reached(own.where(F.col("_bin") == b["_bin"]).groupBy(u, key).agg(F.count("*").alias("n")), [u, key], inside)
    pair, end = F.struct(F.col(u).alias("u"), F.col(key).alias("k")), F.struct(F.lit(last[u]).alias("u"), F.lit(last[key]).cast(df.schema[key].dataType).alias("k"))
    ties = inside - last["until"] + last["n"]
    if ties == last["n"]:
        return df.where(pair <= end)
    return df.where(pair < end).unionByName(df.where(pair == end).limit(ties))


def missing_at_random(df: DataFrame, key: str, column: str, rates: Mapping[str, float], by: str, default: float, *, seed: int) -> DataFrame:
    """Nulls in ``column`` with a probability that depends on another column."""
    rate = F.lit(default)
    for value, r in rates.items():
        rate = F.when(F.col(by) == value, r).otherwise(rate)
    return df.withColumn(column, F.when(uniform(seed, f"missing:{column}", F.col(key)) >= rate, F.col(column)))


def with_gaps(df: DataFrame, key: str, gaps: Mapping[str, tuple[Mapping[str, float], float]], by: str, *, seed: int) -> DataFrame:
    """missing_at_random() for several columns: column -> (rates by the value of ``by``, other rate). What was missing before stays so."""
    for column, (rates, other) in gaps.items():
        df = missing_at_random(df, key, column, rates, by, other, seed=seed)
    return df


def boosted(trait: Column, category: Column, boosts: Mapping[str, float]) -> Column:
    """A trait within 0 to 1, moved by its category's boost; null and other categories move nothing."""
    return clipped(trait + mapped(category, boosts, 0.0), 0.0, 1.0)


def noisy_proxy(truth: Column, sensitivity: float, u: Column) -> Column:
    """A flag that shows a true one with a probability of ``sensitivity`` and never a false one."""
    return truth & (u < sensitivity)


def noisy_category(value: Column, categories: Sequence[str], reliability: float, u: Column, other: Column) -> Column:
    """A category that is right with a probability of ``reliability`` and else drawn by ``other`` from all."""
    drawn = F.element_at(F.array(*map(F.lit, categories)), (F.floor(other * len(categories)) + 1).cast("int"))
    return F.when(u < reliability, value).otherwise(drawn)


def compressed(value: Column, edges: Sequence[tuple[float, str]], above: str) -> Column:
    """The band of a value, in place of it."""
    return band(value, edges, above)


def soft_cap(x: Column, floor: float, cap: float, width: float, u: Column) -> Column:
    """At least ``floor``; what is above ``cap`` falls to somewhere within ``width`` under it, in whole numbers."""
    return F.when(x > cap, F.bround(F.lit(cap) - width * u)).when(x < floor, F.lit(floor)).otherwise(x)


def trap(count: Column, label: Column, u: Column, rate_if: float = 3.0, rate_else: float = 1.0) -> Column:
    """A count that is raised with the label, on purpose."""
    return count + F.when(label == 1, poisson(F.lit(rate_if), u)).otherwise(poisson(F.lit(rate_else), u))


def distorted(df: DataFrame, key: str, columns: Sequence[str], *, noise: float, missing: float, outliers: float, seed: int, non_negative: Sequence[str] = (), counts: Sequence[str] = ()) -> DataFrame:
    """Noise, then missing cells, then outliers, in this order; only ``columns`` change, and ``counts``, of which cells go missing and no more.

    Noise is normal with ``noise`` times a column's sample deviation, and non-negative columns are clamped. Outliers are put at the median plus or minus five
    deviations, both taken after the first two steps. Columns without spread stay as they are.
    """
    if not columns and not counts:
        return df
    k = F.col(key)
    first = df.agg(*(F.stddev_samp(c).alias(f"s_{c}") for c in columns))  # one row
    out = df.crossJoin(F.broadcast(first))
    for c in columns:
        noisy = F.when(F.col(f"s_{c}") > 0, F.col(c) + noise * F.col(f"s_{c}") * normal(seed, f"noise:{c}", k)).otherwise(F.col(c))
        noisy = F.when(noisy < 0, F.lit(0.0)).otherwise(noisy) if c in non_negative else noisy
        out = out.withColumn(c, F.when(fast_uniform(seed, f"mask:{c}", k) >= missing, noisy))
    out = out.drop(*(f"s_{c}" for c in columns)).withColumns({c: F.when(fast_uniform(seed, f"mask:{c}", k) >= missing, F.col(c)) for c in counts})
    if not outliers:
        return out.select(df.columns)
    second = out.agg(*(F.stddev_samp(c).alias(f"s_{c}") for c in columns))
    for c in columns:
        second = second.crossJoin(quantiles(out, c, {f"m_{c}": 0.5}))  # one row each
    out = out.crossJoin(F.broadcast(second))
    for c in columns:
        side = F.when(fast_uniform(seed, f"side:{c}", k) < 0.5, -5.0).otherwise(5.0)
        hit = F.col(c).isNotNull() & (F.col(f"s_{c}") > 0) & (fast_uniform(seed, f"outlier:{c}", k) < outliers)
        out = out.withColumn(c, F.when(hit, F.col(f"m_{c}") + side * F.col(f"s_{c}")).otherwise(F.col(c)))
    return out.select(df.columns)


def _poisson_table(most: int) -> tuple[str, ...]:
    """The distribution function of Poisson(1) at 0, 1, ..., most - 1, as eight hexadecimal digits."""
    total = list(itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(most)))
    return tuple(f"{min(int(x * (1 << 32)), (1 << 32) - 1):08x}" for x in total)


POISSON_1 = _poisson_table(12)


def bootstrap(df: DataFrame, key: str, value: Column, *, replicates: int = 200, seed: int) -> DataFrame:
    """(low, median, high): 2.5, 50 and 97.5 % quantiles of the mean of ``value`` over resamples with replacement.

    Each row's weight in a replicate is a Poisson(1) draw, so no resample is materialised; one partial sum per task and replicate is shuffled. A draw is read off a table of the distribution
    function by eight hexadecimal digits of a hash, of which one serves four replicates; counts above 12, one in six billion, count as 12.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("bootstrap"), F.col("k").cast("string"), F.col("block").cast("string")))
    rows = df.select(F.col(key).alias("k"), value.cast("double").alias("x")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // 4) - 1))))
    rows = rows.select("x", "block", digest.alias("digest")).select("x", "block", "digest", F.explode(F.array(*map(F.lit, range(4)))).alias("part"))
    u = F.substring(F.col("digest"), 8 * F.col("part") + 1, F.lit(8))
    weight = F.lit(len(POISSON_1))
    for count, until in reversed(list(enumerate(POISSON_1))):
        weight = F.when(u < until, count).otherwise(weight)
    rows = rows.select("x", (4 * F.col("block") + F.col("part")).alias("replicate"), weight.alias("w")).where(F.col("replicate") < replicates)
    means = rows.groupBy("replicate").agg(F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum("w")).alias("m"))
    return means.agg(*(F.percentile("m", q).alias(name) for name, q in (("low", 0.025), ("median", 0.5), ("high", 0.975))))
