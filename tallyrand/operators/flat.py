"""Flat teaching datasets from a lead snapshot: derived columns, a soft cap, waves, renaming, a stratified sample and structured gaps, by configuration."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.random import poisson, uniform
from ..functions.scalars import clipped, day_of
from ..sources.tables import materialised, stored
from .ranking import ranked
from .sampling import soft_cap, stratified, with_gaps

LEAKAGE = "__leakage__"
# Names of the flat columns, by the snapshot's.
NAMES = {
    "industry": "industry", "region": "region", "employee_band": "company_size", "estimated_revenue_band": "company_revenue", "role_function": "contact_role", "seniority": "seniority", "lead_source": "lead_source",
    "opportunity_created": "opportunity_created", "demo_completed": "demo_completed", "expected_acv": "expected_acv", "inbound_touch_count": "inbound_touches", "outbound_touch_count": "outbound_touches", "touches_days_0_7": "touches_week_1",
    "touches_last_7_days": "touches_last_7_days", "days_since_first_touch": "days_since_first_touch", "session_count": "web_sessions", "activity_count": "sales_activities", "days_since_last_touch": "days_since_last_touch",
    "acquisition_wave": "acquisition_wave", "total_touches_all": f"{LEAKAGE}total_touches_90d", "converted": "converted",
}


# Gaps by version, each column's rates by lead source and its rate for all others. What the snapshot has no value for stays missing.
_V5 = {"web_sessions": ({"sdr_outbound": 0.15, "inbound_marketing": 0.02, "partner_referral": 0.05}, 0.0), "seniority": ({"partner_referral": 0.08}, 0.01), "days_since_last_touch": ({}, 0.03), "days_since_first_touch": ({}, 0.02)}
_V4 = {c: x for c, x in _V5.items() if c != "days_since_first_touch"}
GAPS: dict[str, dict[str, tuple[Mapping[str, float], float]]] = {"v4": _V4, "v5": _V5, "v6": _V5 | {"expected_acv": ({}, 0.02)}}


@dataclass(frozen=True)
class Flat:
    """seed, rows and their rate of conversions; cap: (floor, cap, width) of the expected value; gaps: column -> (rates by lead source, other rate)."""

    seed: int = 42
    n: int = 1000
    rate: float = 0.25
    cap: tuple[float, float, float] = (10_000.0, 120_000.0, 5_000.0)
    gaps: Mapping[str, tuple[Mapping[str, float], float]] = field(default_factory=lambda: GAPS["v6"])
    instructor: bool = False


def waves(df: DataFrame, ts: str, key: str, *, noise: float, seed: int) -> DataFrame:
    """df with acquisition_wave: thirds by date (the remainder in C), of which a share ``noise`` is drawn anew."""
    rows = ranked(df, F.unix_date(day_of(F.col(ts))), [key], total="_n")
    third = F.floor(F.col("_n") / 3)
    wave = F.when(F.col("rn") <= third, "A").when(F.col("rn") <= 2 * third, "B").otherwise("C")
    other = F.element_at(F.array(*map(F.lit, "ABC")), (F.floor(uniform(seed, "wave", F.col(key)) * 3) + 1).cast("int"))
    return rows.withColumn("acquisition_wave", F.when(uniform(seed, "wave-noise", F.col(key)) < noise, other).otherwise(wave)).drop("rn", "_n")


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """The columns of ``names``, renamed, in its order; raises where one is missing."""
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"no columns {missing}")
    return df.select(*(F.col(a).alias(b) for a, b in names.items()))


def flat_dataset(snapshot: DataFrame, config: Flat) -> DataFrame:
    """A flat dataset of ``config.n`` leads; only instructors get the leaking column."""
    floor, cap, width = config.cap
    rows = snapshot.withColumns({
        "demo_completed": (F.col("demo_page_views") > 0).cast("int"),
        "opportunity_created": F.col("opportunity_created").cast("int"),
        "converted": F.col("converted_within_90_days").cast("int"),
        "expected_acv": soft_cap(F.col("expected_acv"), floor, cap, width, uniform(config.seed, "softcap", F.col("lead_id"))),
    })
    # The snapshot is made once, and its sample is taken once: both are read several times.
    rows = stored(rows.select("lead_id", "lead_created_at", *(c for c in NAMES if c in rows.columns)))
    rows = materialised(stratified(rows, "lead_id", "converted", config.n, config.rate, seed=config.seed))
    rows = waves(rows, "lead_created_at", "lead_id", noise=0.05, seed=config.seed)
    out = renamed(rows, {"lead_id": "lead_id", **NAMES})
    out = with_gaps(out, "lead_id", config.gaps, "lead_source", seed=config.seed)
    out = out.drop("lead_id")
    return out if config.instructor else out.drop(*(c for c in out.columns if c.startswith(LEAKAGE)))


@dataclass(frozen=True)
class Version:
    """A flat dataset as a list of steps over a lead snapshot of day ``day``.

    cap: "hard", "soft" or None, of the expected value, to (floor, cap); waves: acquisition waves over the whole snapshot; trap: the column that the leak comes from, "all" touches or those "after" the snapshot's day, under ``leak``;
    boost: the rate of a Poisson count that converted leads get on top of it; instructor_only: students don't get the leak; without: columns of NAMES that the version lacks; refill: negatives stand in for missing positives.
    """

    day: int = 20
    seed: int = 42
    n: int = 1000
    rate: float = 0.30
    cap: str | None = "soft"
    bounds: tuple[float, float] = (18_000.0, 120_000.0)
    width: float = 5_000.0
    waves: bool = True
    gaps: str = "v6"
    trap: str | None = "after"
    leak: str = f"{LEAKAGE}touches_post_snapshot_21_90"
    boost: float | None = None
    instructor_only: bool = True
    without: tuple[str, ...] = ()
    refill: bool = False


# The published versions.
VERSIONS = {
    "v4": Version(day=10, cap=None, waves=False, gaps="v4", trap="all", leak="total_touches_all", instructor_only=False, without=("touches_last_7_days", "days_since_first_touch", "acquisition_wave"), refill=True),
    "v5": Version(day=10, cap="hard", waves=False, gaps="v5", trap="all", leak=f"{LEAKAGE}total_touches_90d", boost=1.0, instructor_only=False, without=("touches_last_7_days", "acquisition_wave")),
    "v6": Version(boost=3.0),
    "v7": Version(),
    "midproject": Version(seed=100, n=1200, trap=None),
}


def touches_after(touches: DataFrame, leads: DataFrame, day: int, horizon: int = 90) -> DataFrame:
    """(lead_id, touches_after): each lead's touches later than ``day`` and up to ``horizon`` days after its creation, for leads that have one."""
    dated = touches.select("lead_id", day_of(F.col("touch_timestamp")).alias("_at")).join(leads.select("lead_id", day_of(F.col("lead_created_at")).alias("_from")), "lead_id")
    later = F.datediff("_at", "_from")
    return dated.where((later > day) & (later <= horizon)).groupBy("lead_id").agg(F.count("*").alias("touches_after"))


def build(snapshot: DataFrame, version: Version, *, touches: DataFrame | None = None, instructor: bool = False, label: str = "converted_within_90_days") -> DataFrame:
    """A version's rows from a lead snapshot of its day; ``touches``: (lead_id, touch_timestamp), needed where the leak is what comes after the snapshot and is asked for.

    What looks at one row is columns over the snapshot; waves rank the whole snapshot before the sample, as in all versions, and the sample is a top-n of each class, after which n rows are left for the boost and the gaps.
    Raises where a class has too few rows (unless the version refills), a column is missing, or a version without a leak is asked for as an instructor's. Null labels are in no class.
    """
    v, key = version, F.col("lead_id")
    leaks = v.trap is not None and (instructor or not v.instructor_only)
    if instructor and v.trap is None:
        raise ValueError("this version has no instructor's part")
    if leaks and v.trap == "after" and touches is None:
        raise ValueError("touches are needed for the leak")
    floor, cap = v.bounds
    value = F.col("expected_acv")
    if v.cap == "hard":
        value = clipped(value, floor, cap)
    elif v.cap == "soft":
        value = F.bround(soft_cap(value, floor, cap, v.width, uniform(v.seed, "softcap", key)))
    rows = snapshot.withColumns({"demo_completed": (F.col("demo_page_views") > 0).cast("int"), "opportunity_created": F.col("opportunity_created").cast("int"), "expected_acv": value, "converted": F.col(label).cast("int")})
    if v.waves:
        rows = waves(rows, "lead_created_at", "lead_id", noise=0.05, seed=v.seed)
    rows = stratified(rows, "lead_id", "converted", v.n, v.rate, seed=v.seed, refill=v.refill)
    if leaks and v.trap == "after":
        after = touches_after(touches, snapshot.select("lead_id", "lead_created_at"), v.day)
        rows = rows.join(after, "lead_id", "left").fillna(0, ["touches_after"])
    leak = "total_touches_all" if v.trap == "all" else "touches_after"
    if leaks and v.boost is not None:
        extra = F.when(F.col("converted") == 1, poisson(F.lit(v.boost), uniform(v.seed, "boost", key))).otherwise(0)
        rows = rows.withColumn(leak, F.col(leak) + extra)
    names = {a: b for a, b in NAMES.items() if a not in (*v.without, "total_touches_all", "converted")}
    if leaks and not v.instructor_only:
        names |= {leak: v.leak}
    names |= {"converted": "converted"} | ({leak: v.leak} if leaks and v.instructor_only else {})
    out = renamed(rows, {"lead_id": "lead_id", **names})
    return with_gaps(out, "lead_id", GAPS[v.gaps], "lead_source", seed=v.seed).drop("lead_id")
