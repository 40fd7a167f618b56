"""Customer lifecycles, week by week.

Usage drives expansion, expansion compounds, and a failed payment is remembered until it is settled, so weeks depend on each other. Batches of customers are
simulated together as arrays on the executors; draws are hashes of (seed, purpose, customer, week), so the result doesn't depend on the batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.random import choice, fast_uniform, normal
from ..functions.scalars import clipped, entity_id, padded
from ..sources.tables import materialised, stored
from . import motifs as V

EVENTS = "kind string, customer_no long, week int, at date, event_type string, before long, after long, users long, depth double, tickets long, nps long, status string"
USAGE_RAMP, TICKETS, NPS_WEEKS = 6.0, (0.2, 0.8), 13


@dataclass(frozen=True)
class LifecycleWorld:
    seed: int = 42
    motif: str = "expansion_led_growth"
    n_customers: int = 2000
    n_accounts: int = 1500
    start: str = "2022-01-03"
    start_weeks: int = 52
    weeks: int = 182  # 52 weeks of starts, the default cutoff and 730 days behind it

    def __post_init__(self) -> None:
        if self.motif not in V.LIFECYCLE:
            raise ValueError(f"unknown motif {self.motif!r}")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draw(seed: int, purpose: int, customer: np.ndarray, week: int) -> np.ndarray:
    """Uniform in [0, 1) for each customer."""
    with np.errstate(over="ignore"):
        key = _mix(customer.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        key = _mix(key + np.uint64(week * 64 + purpose + 1) * np.uint64(0xD1B54A32D192ED03))
    return (key >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def gauss(seed: int, purpose: int, customer: np.ndarray, week: int) -> np.ndarray:
    a, b = draw(seed, purpose, customer, week), draw(seed, purpose + 1, customer, week)
    return np.sqrt(-2 * np.log1p(-a)) * np.cos(2 * np.pi * b)


def _poisson(u: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """By inverting the distribution function; counts above 15, of which rates under 2 give fewer than one in a billion, count as 15."""
    p = np.exp(-rate)
    total, k = p.copy(), np.zeros(len(u), np.int64)
    for i in range(1, 16):
        more = u >= total
        k[more] += 1
        p = p * rate / i
        total = total + p
    return k


def customers(spark: SparkSession, world: LifecycleWorld) -> DataFrame:
    """Customers with staggered starts, a plan with its price, a contract term and latent traits (half of them their account's)."""
    key = F.col("customer_no")
    u = lambda stream: fast_uniform(world.seed, stream, key)
    out = spark.range(1, world.n_customers + 1).withColumnRenamed("id", "customer_no").withColumn("account_no", F.floor(u("account") * world.n_accounts) + 1)
    plan = choice(u("plan"), {"starter": 0.45, "growth": 0.38, "enterprise": 0.17})
    out = out.withColumn("initial_plan", plan)
    low = F.when(F.col("initial_plan") == "starter", 800).when(F.col("initial_plan") == "growth", 2000).otherwise(6000)
    high = F.when(F.col("initial_plan") == "starter", 2000).when(F.col("initial_plan") == "growth", 6000).otherwise(20000)
    account = lambda t: clipped(0.5 + 0.15 * normal(world.seed, f"account:{t}", F.col("account_no")), 0.0, 1.0)
    own = lambda t: clipped(0.5 + 0.15 * normal(world.seed, f"customer:{t}", key), 0.0, 1.0)
    blended = {t: (account(t) + own(t)) / 2 if t in ("organizational_stability", "budget_stability") else own(t) for t in V.CUSTOMER_TRAITS}
    return out.select(
        "customer_no", entity_id("cust", key).alias("customer_id"), entity_id("acct", F.col("account_no")).alias("account_id"), F.date_format(F.date_add(F.lit(world.start).cast("date"), (F.floor(u("start") * world.start_weeks) * 7).cast("int")), "yyyy-MM-dd").alias("customer_start_at"),
        "initial_plan", (low + F.floor(u("mrr") * (high - low))).cast("long").alias("initial_mrr"), choice(u("term"), {"12": 0.7, "24": 0.2, "6": 0.1}).cast("long").alias("contract_term_months"), entity_id("csm", F.floor(u("csm") * 8) + 1).alias("csm_rep_id"),
        *(c.alias(f"latent_{t}") for t, c in blended.items()),
    )


def _factor(rows: pd.DataFrame, weights: Mapping[str, float]) -> np.ndarray:
    return np.exp(sum(w * (rows[f"latent_{t}"].fillna(0.5).to_numpy() - 0.5) for t, w in weights.items()))


def _weeks(world: LifecycleWorld, rows: pd.DataFrame, health_weeks: int | None = None) -> Iterator[pa.RecordBatch]:
    m = V.LIFECYCLE[world.motif]
    (churn_base, churn_w), (spike, renewal_w), (grow_base, grow_w, (lo, hi)), (fail_base, fail_w, dunning, recovery) = m["churn"], m["renewal"], m["expansion"], m["payment"]
    who = rows["customer_no"].to_numpy()
    term = rows["contract_term_months"].to_numpy() * 13 / 3
    churn, renew, grow = churn_base * _factor(rows, churn_w), spike * _factor(rows, renewal_w), grow_base * _factor(rows, grow_w)
    fail = np.minimum(V.MOST, fail_base * _factor(rows, fail_w))
    adoption, fit, champion = (rows[f"latent_{t}"].fillna(0.5).to_numpy() for t in ("adoption_velocity", "product_fit", "champion_strength"))
    base_users = rows["initial_plan"].map({p: v[2] for p, v in V.PLANS.items()}).to_numpy()
    mrr = rows["initial_mrr"].to_numpy().copy()
    begun = rows["customer_start_at"].to_numpy().astype("datetime64[D]")
    alive, pending, owed = np.ones(len(rows), bool), np.full(len(rows), -1), mrr.copy()
    out: list[pa.RecordBatch] = []

    def emit(kind: str, week: int | np.ndarray, at: np.ndarray, **values) -> None:
        if at.any():
            values |= {"kind": kind, "customer_no": who, "week": week, "at": begun + 7 * np.asarray(week)}
            out.append(_arrow(int(at.sum()), {k: v[at] if isinstance(v, np.ndarray) and v.ndim else v for k, v in values.items()}))

    for week in range(world.weeks):
        if not alive.any():
            break
        u = lambda purpose, week=week: draw(world.seed, purpose, who, week)
        ramp = 1 - np.exp(-(week + 1) / USAGE_RAMP)
        depth = np.round(np.clip(np.clip(0.2 + 0.4 * adoption + 0.3 * fit, 0, 1) * ramp + 0.04 * gauss(world.seed, 12, who, week), 0, 1), 4)
        if health_weeks is None or week < health_weeks:
            users = np.maximum(0, np.floor(base_users * (0.5 + adoption) * ramp * (1 + 0.1 * gauss(world.seed, 10, who, week)) + 0.5)).astype(np.int64)
            tickets = _poisson(u(14), TICKETS[0] + TICKETS[1] * (1 - fit))
            nps = np.clip(np.round(10 * (0.2 + 0.5 * fit + 0.3 * champion) + gauss(world.seed, 15, who, week)), 0, 10)
            emit("health", week, alive, users=users, depth=depth, tickets=tickets, nps=nps if week and week % NPS_WEEKS == 0 else np.full(len(who), np.nan))
        # Failed payments are settled before a new invoice can fail.
        due = alive & (pending >= 0) & (week - pending >= dunning)
        saved = due & (u(0) < recovery)
        emit("event", week, saved, event_type="payment_recovered", before=mrr, after=mrr)
        gone = due & ~saved
        # A failed invoice that waits for its settlement is told with it.
        emit("invoice", pending, due, after=owed, status=np.where(saved, "recovered", "written_off"))
        emit("event", week, gone, event_type="churn", before=mrr, after=0, status="payment_failure")
        alive &= ~gone
        pending[due] = -1
        if int(week * 12 / 52) > int((week - 1) * 12 / 52) or week == 0:
            failed = alive & (u(1) < fail)
            new = failed & (pending < 0)
            emit("invoice", week, alive & ~new, after=mrr, status=np.where(failed, "failed", "paid"))
            pending[new], owed[new] = week, mrr[new]
            emit("event", week, new, event_type="payment_failure", before=mrr, after=mrr)
        k = np.round(week / term)
        renewal = (k >= 1) & (np.round(k * term) == week)
        p = churn * (1 + (V.ONBOARDING_PEAK - 1) * np.exp(-week / V.ONBOARDING_WEEKS)) * np.where(renewal, renew, 1.0)
        gone = alive & (u(2) < np.minimum(V.MOST, p))
        emit("event", week, gone, event_type="churn", before=mrr, after=0, status=np.where(renewal, "non_renewal", "voluntary"))
        alive &= ~gone
        emit("event", week, alive & renewal, event_type="renewal", before=mrr, after=mrr)
        more = alive & (u(3) < np.minimum(V.MOST, grow * (0.5 + depth)))
        least = np.maximum(1, (lo * mrr).astype(np.int64))
        added = least + np.floor(u(4) * (np.maximum(least, (hi * mrr).astype(np.int64)) - least + 1)).astype(np.int64)
        emit("event", week, more, event_type="expansion", before=mrr, after=mrr + added)
        mrr = np.where(more, mrr + added, mrr)
        if len(out) > 200:
            yield _joined(out)
            out.clear()
    emit("invoice", pending, pending >= 0, after=owed, status="failed")
    if out:
        yield _joined(out)


TYPES = {"kind": pa.string(), "customer_no": pa.int64(), "week": pa.int32(), "at": pa.date32(), "event_type": pa.string(), "before": pa.int64(), "after": pa.int64(), "users": pa.int64(), "depth": pa.float64(), "tickets": pa.int64(), "nps": pa.int64(), "status": pa.string()}


def _arrow(n: int, values: Mapping[str, object]) -> pa.RecordBatch:
    """n rows: arrays, of which NaN is missing, values that all rows share, and nulls for the rest."""
    arrays = []
    for name, kind in TYPES.items():
        x = values.get(name)
        if x is None:
            arrays.append(pa.nulls(n, kind))
        elif not isinstance(x, np.ndarray) or not x.ndim:
            arrays.append(pa.repeat(pa.scalar(x if isinstance(x, str) else x.item() if isinstance(x, np.generic) else x, kind), n))
        elif x.dtype.kind == "f" and pa.types.is_integer(kind):
            gap = np.isnan(x)
            arrays.append(pa.array(np.where(gap, 0, x).astype(kind.to_pandas_dtype()), kind, mask=gap))
        else:
            arrays.append(pa.array(x, kind) if x.dtype.kind in "UM" else pa.array(x.astype(kind.to_pandas_dtype(), copy=False), kind))
    return pa.RecordBatch.from_arrays(arrays, names=list(TYPES))


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def simulate(spark: SparkSession, world: LifecycleWorld, *, health_weeks: int | None = None) -> dict[str, DataFrame]:
    """customers, subscriptions, subscription_events, health_signals and invoices of a world, over ``weeks`` weeks from each customer's start.

    health_weeks: how many weeks' health signals from each start on the caller reads; later ones, most of the log's rows, aren't made then. All else depends on every week and is the same.
    """
    who = materialised(customers(spark, world), wide=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            for at in range(0, len(rows), 2000):
                yield from _weeks(world, rows.iloc[at : at + 2000].reset_index(drop=True), health_weeks)

    # The log has all that its tables need, so none of them is a join of it.
    log = stored(who.mapInArrow(run, EVENTS)).withColumns({"customer_id": entity_id("cust", F.col("customer_no")), "at": F.date_format("at", "yyyy-MM-dd")})
    numbered = lambda prefix: F.concat_ws("_", F.lit(prefix), padded(F.col("customer_no"), 9), padded(F.col("week"), 3))
    sub = F.concat(F.lit("sub_"), F.substring("customer_id", 6, 20))
    events = log.where("kind = 'event'").select(F.concat_ws("_", numbered("evt"), "event_type").alias("event_id"), sub.alias("subscription_id"), "customer_id", F.col("at").alias("event_timestamp"), "event_type", F.col("before").alias("mrr_before"), F.col("after").alias("mrr_after"), F.when(F.col("event_type") == "churn", F.col("status")).alias("churn_reason"))
    health = log.where("kind = 'health'").select(numbered("sig").alias("signal_id"), "customer_id", F.col("at").alias("period_start"), F.col("users").alias("active_users"), F.col("depth").alias("feature_depth_score"), F.col("tickets").alias("support_tickets"), F.col("nps").alias("nps_score"))
    invoices = log.where("kind = 'invoice'").select(numbered("inv").alias("invoice_id"), "customer_id", F.col("at").alias("invoice_date"), F.col("after").alias("amount_usd"), F.col("status").alias("payment_status"))
    last = events.groupBy("customer_id").agg(F.max(F.when(F.col("event_type") == "churn", F.col("event_timestamp"))).alias("churn_at"), F.max("churn_reason").alias("churn_reason"), F.count_if(F.col("event_type") == "renewal").alias("renewal_count"), F.count_if(F.col("event_type") == "expansion").alias("expansion_count"), F.max(F.when(F.col("event_type") == "expansion", F.col("mrr_after"))).alias("mrr"))
    subscriptions = who.join(last, "customer_id", "left").select(
        sub.alias("subscription_id"), "customer_id", F.col("initial_plan").alias("plan_name"), F.when(F.col("churn_at").isNull(), "active").otherwise("churned").alias("subscription_status"), F.col("customer_start_at").alias("subscription_start_at"),
        F.when(F.col("churn_at").isNull(), F.coalesce("mrr", "initial_mrr")).otherwise(0).alias("current_mrr"), "contract_term_months", F.coalesce("renewal_count", F.lit(0)).alias("renewal_count"), F.coalesce("expansion_count", F.lit(0)).alias("expansion_count"), F.col("churn_at").alias("subscription_end_at"), "churn_at", "churn_reason",
    )
    return {"customers": who.drop("customer_no", *(f"latent_{t}" for t in V.CUSTOMER_TRAITS)), "subscriptions": subscriptions, "subscription_events": events, "health_signals": health, "invoices": invoices}
