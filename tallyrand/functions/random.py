"""Counter-based randomness: every draw is a hash of (seed, stream, key, index), so it is the same under any partitioning and in any engine with md5."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(x) -> Column:
    return x.cast("string") if isinstance(x, Column) else F.lit(str(x))


def uniform(seed, stream: str, key, index=0) -> Column:
    """In [0, 1), in steps of 2^-32."""
    digest = F.md5(F.concat_ws(":", _text(seed), F.lit(stream), _text(key), _text(index)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def fast_uniform(seed, stream: str, key, index=0) -> Column:
    """As uniform(), by xxhash64: quicker, but without a twin in other engines."""
    return F.shiftrightunsigned(F.xxhash64(_text(seed), F.lit(stream), key if isinstance(key, Column) else F.lit(key), index if isinstance(index, Column) else F.lit(index)), 11).cast("double") / float(1 << 53)


def normal(seed, stream: str, key, index=0, draw=fast_uniform) -> Column:
    """Standard normal, by Box and Muller."""
    a, b = draw(seed, stream + ":a", key, index), draw(seed, stream + ":b", key, index)
    return F.sqrt(-2.0 * F.log(1.0 - a)) * F.cos(2.0 * math.pi * b)


def geometric(p: Column, u: Column) -> Column:
    """Trials up to and with the first success of probability p; null where p is 0."""
    return F.when(p >= 1, F.lit(1)).when(p > 0, F.greatest(F.lit(1), F.ceil(F.log1p(-u) / F.log1p(-p))).cast("int"))


#: Counts that poisson() finds by plain comparisons.
SMALL = 3


def poisson(rate: Column, u: Column, most: int = 64) -> Column:
    """By inverting the distribution function; counts above ``most`` count as ``most``.

    Small counts, which are most at low rates, are compared one by one; only what lies above them walks on, by a loop that Spark interprets.
    """
    step = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("k"))
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(most)),
        step,
        lambda s, i: F.when(u < s["c"], s).otherwise(F.struct((s["p"] * rate / i).alias("p"), (s["c"] + s["p"] * rate / i).alias("c"), i.alias("k"))),
    )
    p = c = F.exp(-rate)
    small = F.when(u < c, 0)
    for k in range(1, min(SMALL, most - 1) + 1):
        p = p * rate / k
        c = c + p
        small = small.when(u < c, k)
    return small.otherwise(F.coalesce(walk["k"], F.lit(0)))


def choice(u: Column, weighted: dict[str, float]) -> Column:
    """The value whose share of the cumulated weights holds u."""
    total, run = sum(weighted.values()), 0.0
    values = list(weighted)
    out = F.lit(values[-1])
    for value in reversed(values[:-1]):
        run = sum(weighted[v] for v in values[: values.index(value) + 1]) / total
        out = F.when(u < run, value).otherwise(out)
    return out
