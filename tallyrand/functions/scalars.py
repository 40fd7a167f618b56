"""Scalar expressions with the null, rounding and day rules that the snapshots and audits rely on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of(text: Column) -> Column:
    """A date from ISO text, a date or a timestamp; null where it can't be read."""
    return F.to_date(F.try_to_timestamp(text.cast("string")))


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def floor_weeks(days: Column) -> Column:
    """Whole weeks, downwards for negative days too."""
    return F.floor(days / 7).cast("int")


def clipped(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x within [low, high]; null stays null."""
    out = x
    if low is not None:
        out = F.when(out < low, F.lit(low).cast("double")).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high).cast("double")).otherwise(out)
    return out


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a, b)


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def padded(number: Column, width: int) -> Column:
    """A number's digits with zeros before them up to ``width``; longer numbers keep all their digits."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0"))


def entity_id(prefix: str, number: Column) -> Column:
    """prefix_000001 and so on, with more digits from a million on."""
    return F.concat(F.lit(prefix + "_"), padded(number, 6))


def band(x: Column, edges: Sequence[tuple[float, str]], above: str) -> Column:
    """The label of the first edge that x is below, else ``above``; null for null."""
    out = F.lit(above)
    for edge, label in sorted(edges, reverse=True):
        out = F.when(x < edge, label).otherwise(out)
    return F.when(x.isNotNull(), out)


def mapped(x: Column, values: Mapping[str, float], default=None) -> Column:
    """A value for each key; ``default`` for others and for null."""
    pairs = F.create_map(*(F.lit(v) for kv in values.items() for v in kv))
    return F.coalesce(F.try_element_at(pairs, x), F.lit(default))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def cox_factor(latents: Mapping[str, float], of=F.col) -> Column:
    """exp of the weighted distances of latent traits from one half; an absent trait is one half."""
    total = F.lit(0.0)
    for name, weight in latents.items():
        total = total + weight * (F.coalesce(of(name), F.lit(0.5)) - 0.5)
    return F.exp(total)


def saturating(x: Column, scale: float) -> Column:
    return F.tanh(x / scale)


def thresholded(x: Column, at: float, low: float, high: float) -> Column:
    return F.when(x >= at, high).otherwise(low)


def clipped_linear(x: Column, slope: float, offset: float, low: float = 0.0, high: float = 1.0) -> Column:
    return clipped(slope * x + offset, low, high)


def decayed(rate: Column, days: Column, half_life: float) -> Column:
    return rate * F.exp(-F.log(F.lit(2.0)) * days / half_life)


def ramp(days: Column, over: float, start: float) -> Column:
    """From ``start`` to 1 in a straight line over ``over`` days."""
    return start + (1 - start) * clipped(days / over, 0.0, 1.0)


def is_renewal_week(week: Column, term_months: Column) -> Column:
    """Contract anniversaries fall on the rounded multiples of the term in weeks (13 weeks to 3 months)."""
    per = term_months * 13 / 3
    k = F.greatest(F.lit(1), F.bround(week / per))
    return (week > 0) & (F.bround(k * per) == week)


def next_renewal_week(week: Column, term_months: Column) -> Column:
    """The first anniversary after ``week``."""
    per = term_months * 13 / 3
    k = F.floor(week / per)
    ahead = F.array(*(F.bround((k + i) * per) for i in range(0, 3)))
    return F.array_min(F.filter(ahead, lambda x: x > week)).cast("int")
