"""Checks that are compiled into one aggregation, so that a table is scanned once however many there are."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """A number that one pass gives, and the bounds within which it is right, both included; None doesn't bind. A number that is missing is wrong if anything binds."""

    name: str
    value: Column
    low: float | None = None
    high: float | None = None


def null_share(column: str, most: float) -> Check:
    return Check(f"null_share:{column}", F.avg(F.col(column).isNull().cast("double")), None, most)


def violations(name: str, wrong: Column) -> Check:
    """How many rows are wrong; none may be. Where it can't be told, a row isn't."""
    return Check(f"violations:{name}", F.count_if(F.coalesce(wrong, F.lit(False))).cast("double"), 0.0, 0.0)


def within(column: str, low: float | None, high: float | None) -> Check:
    wrong = F.lit(False)
    for bound, beyond in ((low, F.col(column) < F.lit(low)), (high, F.col(column) > F.lit(high))):
        wrong = wrong if bound is None else wrong | F.coalesce(beyond, F.lit(False))
    return violations(f"{column}_range", wrong)


def known_values(column: str, values: Sequence[str]) -> Check:
    return violations(f"{column}_values", ~F.col(column).isin(*values))


def rate(label: str, low: float | None, high: float | None) -> Check:
    return Check(f"rate:{label}", F.avg(F.col(label).cast("double")), low, high)


def columns_of(checks: Sequence[Check]) -> list[Column]:
    """The aggregates, by place, so that no name can clash."""
    return [c.value.cast("double").alias(f"c{i}") for i, c in enumerate(checks)]


def verdicts(one: DataFrame, checks: Sequence[Check], keep: Sequence[str] = ()) -> DataFrame:
    """(keep, check, value, ok) of a frame with columns_of(checks)."""
    rows = []
    for i, c in enumerate(checks):
        x, ok = F.col(f"c{i}"), F.lit(True)
        for bound, inside in ((c.low, x >= F.lit(c.low)), (c.high, x <= F.lit(c.high))):
            ok = ok if bound is None else ok & F.coalesce(inside, F.lit(False))
        rows.append(F.struct(F.lit(c.name).alias("check"), x.alias("value"), ok.alias("ok")))
    return one.select(*keep, F.explode(F.array(*rows)).alias("r")).select(*keep, "r.*")


def checked(df: DataFrame, checks: Sequence[Check], group: Sequence[str] = ()) -> DataFrame:
    """(group, check, value, ok) of all checks, for every group or the whole table, from one scan and one aggregation."""
    return verdicts(df.groupBy(*group).agg(*columns_of(checks)), checks, group)


def broken(values: Mapping[str, float | None], checks: Sequence[Check]) -> list[str]:
    """What is wrong by the numbers of columns_of(checks), as text."""
    out = []
    for i, c in enumerate(checks):
        x = values[f"c{i}"]
        if (c.low is not None and (x is None or x < c.low)) or (c.high is not None and (x is None or x > c.high)):
            out.append(f"{c.name} is {x}, not within {c.low} to {c.high}")
    return out


def observed_write(df: DataFrame, path: str, columns: Sequence[Column], files: int | None = None) -> dict:
    """Writes df as Parquet and returns the aggregates ``columns`` over the very rows written: they are taken in the tasks that write, so nothing is read back."""
    seen = Observation()
    out = df.observe(seen, *columns)
    (out if files is None else out.coalesce(files)).write.mode("overwrite").parquet(path)
    return seen.get
