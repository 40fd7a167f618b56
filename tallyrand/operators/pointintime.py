"""Point-in-time features: what was known about each entity at its cutoff.

A cutoff is a column: one date for all, or a date per entity. All features of an event table come from one pass with conditional aggregates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import day_of


class SnapshotError(ValueError):
    """The input doesn't allow a safe snapshot."""


def first_days(events: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, anchor): each entity's first day."""
    return events.groupBy(key).agg(F.to_date(F.min(ts)).alias("anchor"))


def asserted(condition: Column, message: Column, value: Column) -> Column:
    """value where the condition holds; elsewhere the job fails with the message, in the very task that meets the row. It costs no job of its own."""
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(message).cast("int"))


def with_day(events: DataFrame, anchors: DataFrame, key: str, ts: str, orphans: str = "drop") -> DataFrame:
    """Events of anchored entities with ``day``, the days since the anchor. Rows without a readable time are dropped; ``orphans``: events without an anchor are dropped ("drop") or fail the job that reads ``day`` ("raise"), which names one of them."""
    at = F.datediff(day_of(F.col(ts)), F.col("anchor"))
    if orphans == "drop":
        return events.join(anchors.select(key, "anchor"), key).withColumn("day", at).where(F.col("day").isNotNull())
    if orphans != "raise":
        raise SnapshotError(f"orphans: drop or raise, not {orphans!r}")
    known = anchors.select(key, "anchor", F.lit(True).alias("_known"))
    at = asserted(F.col("_known"), F.concat(F.lit(f"event without an anchor: {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))), at)
    return events.join(known, key, "left").withColumn("day", at).drop("_known").where(F.col("day").isNotNull())


def touch_features(events: DataFrame, key: str, window: int | None, kinds: Mapping[str, Column], horizon: int = 90) -> DataFrame:
    """Counts and recencies of events(key, day, ...) up to day ``window``; total_all counts the whole history, as a trap.

    first_week: days 0 to 7, last_week: the seven days up to the window's end; both within the window. Without a window, all events count
    and last_week is that up to day ``horizon``.
    """
    inside = F.lit(True) if window is None else F.col("day") <= window
    end = F.lit(horizon if window is None else window)
    count = lambda c: F.count_if(c)
    return events.groupBy(key).agg(
        count(inside).alias("n_events"),
        *(count(inside & c).alias(f"n_{name}") for name, c in kinds.items()),
        count(inside & (F.col("day") <= 7)).alias("first_week"),
        count(inside & (F.col("day") > end - 7)).alias("last_week"),
        F.min(F.when(inside, F.col("day"))).alias("first_day"),
        F.max(F.when(inside, F.col("day"))).alias("last_day"),
        F.count("*").alias("total_all"),
    )


def onto_spine(spine: DataFrame, features: DataFrame, key: str, counts: Sequence[str]) -> DataFrame:
    """Every entity of the spine with its features; counts are 0 where it has none, recencies stay null."""
    return spine.join(features, key, "left").fillna(0, list(counts))


def windowed_snapshot(spine: DataFrame, events: DataFrame, *, key: str, ts: str, window: int | None, kinds: Mapping[str, Column], anchors: DataFrame | None = None, horizon: int = 90) -> DataFrame:
    """One row per entity of the spine: touch_features() with days_since_first and days_since_last as of the window's end, or of day ``horizon`` without one."""
    anchors = first_days(events, key, ts) if anchors is None else anchors
    found = touch_features(with_day(events, anchors, key, ts), key, window, kinds, horizon)
    end = F.lit(horizon if window is None else window)
    found = found.withColumns({"days_since_first": end - F.col("first_day"), "days_since_last": end - F.col("last_day")}).drop("first_day", "last_day")
    return onto_spine(spine, found, key, [c for c in found.columns if c.startswith("n_") or c in ("first_week", "last_week", "total_all")])


def safe_events(events: DataFrame, anchors: DataFrame, *, key: str, ts: str, window: int, orphans: str = "drop") -> DataFrame:
    """Events up to ``window`` days after their entity's anchor; later ones and rows without a readable time are dropped. Events without an anchor are dropped too, or fail the job ("raise").

    The latest possible day also bounds the scan, so files that begin after it are skipped.
    """
    checked_anchors(anchors, key, window)
    return with_day(events, anchors, key, ts, orphans).where(F.col("day") <= window).select(events.columns)


def checked_anchors(anchors: DataFrame, key: str, window: int) -> None:
    if window < 0:
        raise SnapshotError("the window must not be negative")
    missing = {key, "anchor"} - set(anchors.columns)
    if missing:
        raise SnapshotError(f"anchors lack {sorted(missing)}")
    bad = anchors.agg(F.count_if(F.col(key).isNull() | F.col("anchor").isNull()).alias("nulls"), (F.count(key) - F.count_distinct(key)).alias("again")).first()
    if bad["nulls"] or bad["again"]:
        raise SnapshotError(f"{bad['nulls']} anchors without a key or a date, {bad['again']} repeated keys")


def until(events: DataFrame, ts: str, cutoff: str) -> DataFrame:
    """Events up to one cutoff for all, compared as they are stored, so that the filter reaches the scan."""
    kind = dict(events.dtypes)[ts]
    return events.where(F.col(ts) <= F.lit(cutoff).cast(kind))


def safe_tables(tables: Mapping[str, DataFrame], *, window: int, leads: str = "leads", key: str = "lead_id", anchor: str = "lead_created_at", times: Mapping[str, str], banned: Mapping[str, Sequence[str]], omitted: Sequence[str], orphans: str = "drop") -> dict[str, DataFrame]:
    """The tables of a bundle as they may be published: without banned columns and omitted tables, event tables cut at each lead's anchor plus ``window`` days. Events without a lead are dropped, or fail the job that writes them ("raise")."""
    if leads not in tables or not {key, anchor} <= set(tables[leads].columns):
        raise SnapshotError(f"{leads} with {key} and {anchor} is needed")
    anchors = tables[leads].select(key, day_of(F.col(anchor)).alias("anchor"))
    checked_anchors(anchors, key, window)
    out = {}
    for name, df in tables.items():
        if name in omitted:
            continue
        if name in times:
            df = with_day(df, anchors, key, times[name], orphans).where(F.col("day") <= window).select(df.columns)
        out[name] = df.drop(*banned.get(name, ()))
    return out


def open_at(created: Column, closed: Column, cutoff: Column) -> Column:
    """Known at the cutoff and not closed by then."""
    return F.coalesce((created <= cutoff) & (closed.isNull() | (closed > cutoff)), F.lit(False))


def first_open(rows: DataFrame, key: str, created: Column, closed: Column, cutoff: Column, value: Column, tie: Column) -> DataFrame:
    """(key, any_created, has_open, open_value): the value of the earliest open row that has one."""
    is_open = open_at(created, closed, cutoff)
    picked = F.min_by(value, F.when(is_open & value.isNotNull(), F.struct(created, tie)))
    return rows.groupBy(key).agg(F.bool_or(F.coalesce(created <= cutoff, F.lit(False))).alias("any_created"), F.bool_or(is_open).alias("has_open"), picked.alias("open_value"))


def forward_sums(rows: DataFrame, key: str, day: Column, value: Column, counts: Column, spans: Sequence[int], name: str = "revenue") -> DataFrame:
    """Sums of value over (0, span] days after the cutoff for several spans at once; day: days since the cutoff."""
    return rows.groupBy(key).agg(*(F.sum(F.when(counts & (day > 0) & (day <= s), value).otherwise(0.0)).alias(f"{name}_{s}d") for s in spans))


def trailing(rows: DataFrame, key: str, day: Column, span: int, aggregates: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Aggregates ('avg', 'sum', 'count' of a column, or 'slope' of it over the days) of the days in (-span, 0] relative to the cutoff."""
    inside = (day > -span) & (day <= 0)
    made = []
    for name, (how, value) in aggregates.items():
        held = F.when(inside, value)
        x = F.when(inside & value.isNotNull(), day.cast("double"))
        made.append({"avg": lambda h, x: F.avg(h), "sum": lambda h, x: F.sum(h), "count": lambda h, x: F.count(h), "slope": lambda h, x: F.regr_slope(h, x)}[how](held, x).alias(name))
    return rows.groupBy(key).agg(*made)


def last_known(rows: DataFrame, key: str, at: Column, value: Column, name: str) -> DataFrame:
    """(key, name): the latest value that isn't null."""
    return rows.groupBy(key).agg(F.max_by(value, F.when(value.isNotNull(), at)).alias(name))
