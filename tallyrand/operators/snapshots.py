"""The two snapshots of simulated worlds, each one row per entity at its cutoff, with the columns of its catalogue in order."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..generate.motifs import REVENUE_MIDPOINT
from ..sources.tables import materialised
from .pointintime import SnapshotError, open_at
from .sampling import distorted


@dataclass(frozen=True)
class Feature:
    name: str
    dtype: str
    role: str = "feature"  # feature, key, trap or target
    non_negative: bool = False
    redacted_in: tuple[str, ...] = ()


# The columns of the lead snapshot, in order.
LEAD_FEATURES = (
    Feature("account_id", "string", role="key"),
    Feature("industry", "string"),
    Feature("region", "string"),
    Feature("employee_band", "string"),
    Feature("estimated_revenue_band", "string"),
    Feature("process_maturity_band", "string"),
    Feature("contact_id", "string", role="key"),
    Feature("role_function", "string"),
    Feature("seniority", "string"),
    Feature("buyer_role", "string"),
    Feature("lead_id", "string", role="key"),
    Feature("lead_created_at", "string"),
    Feature("lead_source", "string"),
    Feature("current_stage", "string", redacted_in=("public",)),
    Feature("is_sql", "boolean", redacted_in=("public",)),
    Feature("touch_count", "long", non_negative=True),
    Feature("inbound_touch_count", "long", non_negative=True),
    Feature("outbound_touch_count", "long", non_negative=True),
    Feature("session_count", "long", non_negative=True),
    Feature("pricing_page_views", "long", non_negative=True),
    Feature("demo_page_views", "long", non_negative=True),
    Feature("total_session_duration_seconds", "long", non_negative=True),
    Feature("touches_days_0_7", "long", non_negative=True),
    Feature("touches_last_7_days", "long", non_negative=True),
    Feature("days_since_first_touch", "double", non_negative=True),
    Feature("activity_count", "long", non_negative=True),
    Feature("days_since_last_touch", "double", non_negative=True),
    Feature("opportunity_created", "boolean"),
    Feature("has_open_opportunity", "boolean"),
    Feature("opportunity_estimated_acv", "double", non_negative=True),
    Feature("expected_acv", "double", non_negative=True),
    Feature("total_touches_all", "long", role="trap", non_negative=True),
    Feature("converted_within_90_days", "boolean", role="target"),
)
# The columns of the customer snapshot, in order.
CUSTOMER_FEATURES = (
    Feature("customer_id", "string", role="key"),
    Feature("account_id", "string", role="key"),
    Feature("industry", "string"),
    Feature("region", "string"),
    Feature("employee_band", "string"),
    Feature("estimated_revenue_band", "string"),
    Feature("tenure_weeks", "long", non_negative=True),
    Feature("initial_plan", "string"),
    Feature("initial_mrr", "long", non_negative=True),
    Feature("current_mrr", "long", non_negative=True),
    Feature("mrr_change_at_snapshot", "long"),
    Feature("renewal_count", "long", non_negative=True),
    Feature("expansion_count", "long", non_negative=True),
    Feature("contract_term_months", "long", non_negative=True),
    Feature("weeks_to_next_renewal", "long", non_negative=True),
    Feature("avg_active_users_l12w", "double", non_negative=True),
    Feature("active_user_trend_l12w", "double"),
    Feature("avg_feature_depth_l12w", "double", non_negative=True),
    Feature("support_ticket_count_l12w", "long", non_negative=True),
    Feature("last_nps_score", "long", non_negative=True),
    Feature("payment_failure_count", "long", non_negative=True),
    Feature("weeks_since_last_payment_failure", "long", non_negative=True),
    Feature("mrr_change_full_period", "long", role="trap"),
    Feature("ltv_revenue_90d", "double", role="target"),
    Feature("ltv_revenue_365d", "double", role="target"),
    Feature("ltv_revenue_730d", "double", role="target"),
    Feature("churned_within_180d", "boolean", role="target"),
)


#: The longest target window of the customer snapshot, its window of recent usage, and the states of invoices that count as revenue.
TARGET_DAYS, RECENT_DAYS, PAID = 730, 84, ("paid", "recovered")


def catalogue(df: DataFrame, features: tuple[Feature, ...]) -> DataFrame:
    """The features in order, each cast to its type."""
    return df.select(*(F.col(f.name).cast(f.dtype).alias(f.name) for f in features))


def redacted_for(mode: str, features: tuple[Feature, ...]) -> list[str]:
    return [f.name for f in features if mode in f.redacted_in]


def single_target(df: DataFrame, features: tuple[Feature, ...], target: str) -> DataFrame:
    """Without any other target."""
    return df.drop(*(f.name for f in features if f.role == "target" and f.name != target))


@dataclass(frozen=True)
class Difficulty:
    """How far a snapshot is distorted: noise in deviations, shares of missing cells and of outliers."""

    noise: float = 0.0
    missing: float = 0.0
    outliers: float = 0.0


def made_difficult(df: DataFrame, features: tuple[Feature, ...], key: str, difficulty: Difficulty, seed: int) -> DataFrame:
    """A snapshot of ``features`` with distorted() numbers: noise and outliers in the doubles, missing cells in doubles and counts; keys, traps and targets stay as they are."""
    own = [f for f in features if f.role == "feature" and f.name in df.columns]
    doubles, counts = ([f.name for f in own if f.dtype == t] for t in ("double", "long"))
    if not (difficulty.noise or difficulty.missing or difficulty.outliers):
        return df
    return distorted(df, key, doubles, noise=difficulty.noise, missing=difficulty.missing, outliers=difficulty.outliers, seed=seed, non_negative=[f.name for f in own if f.non_negative], counts=counts)


def lead_snapshot(t: Mapping[str, DataFrame], *, window: int | None = 30, horizon: int = 90) -> DataFrame:
    """A lead world at ``window`` days after each lead's creation; None: ``horizon`` days after it, with all events.

    Touches, sessions and activities become one narrow table, whose days are read before it is shuffled by lead, and are counted together by hashing. Opportunities, of which the earliest is looked for by sorting,
    are aggregated apart. Accounts and contacts are joined before the counts, so wide rows aren't shuffled.
    """
    pad = {"kind": "string", "at": "date", "flag": "boolean", "a": "long", "b": "long", "c": "long"}

    def rows(name: str, kind: str, ts: str, **values: Column) -> DataFrame:
        values |= {"kind": F.lit(kind), "at": S.day_of(F.col(ts))}
        return t[name].select("lead_id", *(values.get(c, F.lit(None)).cast(d).alias(c) for c, d in pad.items())).where(F.col("at").isNotNull())

    events = (
        rows("touches", "touch", "touch_timestamp", flag=F.col("touch_direction") == "inbound")
        .unionByName(rows("sessions", "session", "session_timestamp", a=F.col("pricing_page_views"), b=F.col("demo_page_views"), c=F.col("session_duration_seconds")))
        .unionByName(rows("sales_activities", "activity", "activity_timestamp"))
    )
    deals = t["opportunities"].select("lead_id", F.col("created_at").cast("string").alias("ts"), S.day_of(F.col("created_at")).alias("at"), F.col("estimated_acv").cast("long").alias("a"), S.day_of(F.col("closed_at")).alias("closed"), F.col("opportunity_id").cast("string").alias("tie")).where(F.col("at").isNotNull())
    anchors = t["leads"].select("lead_id", S.day_of(F.col("lead_created_at")).alias("anchor"))
    dated, deals = (x.join(anchors, "lead_id").withColumn("day", F.datediff("at", "anchor")).where(F.col("day").isNotNull()) for x in (events, deals))
    inside = F.lit(True) if window is None else F.col("day") <= window
    end = F.lit(horizon if window is None else window)
    is_ = lambda kind: F.col("kind") == kind
    touch, session = is_("touch") & inside, is_("session") & inside
    last = F.max(F.when(touch, F.col("day")))
    per = dated.groupBy("lead_id").agg(
        F.count_if(touch).alias("touch_count"), F.count_if(touch & F.col("flag")).alias("inbound_touch_count"), F.count_if(touch & ~F.col("flag")).alias("outbound_touch_count"),
        F.count_if(session).alias("session_count"), F.sum(F.when(session, F.col("a"))).alias("pricing_page_views"), F.sum(F.when(session, F.col("b"))).alias("demo_page_views"), F.sum(F.when(session, F.col("c"))).alias("total_session_duration_seconds"),
        F.count_if(touch & (F.col("day") <= 7)).alias("touches_days_0_7"), F.count_if(touch & (F.col("day") > end - 7)).alias("touches_last_7_days"), (end - F.min(F.when(touch, F.col("day")))).alias("days_since_first_touch"), F.count_if(is_("activity") & inside).alias("activity_count"), (end - last).alias("days_since_last_touch"),
        F.count_if(is_("touch")).alias("total_touches_all"),
    )
    open_ = open_at(F.col("at"), F.col("closed"), F.date_add("anchor", end))
    deals = deals.groupBy("lead_id").agg(F.bool_or(inside).alias("opportunity_created"), F.bool_or(open_).alias("has_open_opportunity"), F.min_by("a", F.when(open_ & F.col("a").isNotNull(), F.struct("ts", "tie"))).alias("opportunity_estimated_acv"))
    counts = [f.name for f in LEAD_FEATURES if f.dtype == "long"]
    out = t["leads"].join(t["accounts"].drop("created_at"), "account_id", "left").join(t["contacts"].select("contact_id", "role_function", "seniority", "buyer_role"), "contact_id", "left")
    out = out.join(per, "lead_id", "left").join(deals, "lead_id", "left").fillna(0, counts).fillna(False, ["opportunity_created", "has_open_opportunity"])
    out = out.withColumn("expected_acv", F.coalesce(F.col("opportunity_estimated_acv").cast("double"), S.mapped(F.col("estimated_revenue_band"), REVENUE_MIDPOINT)))
    return catalogue(out, LEAD_FEATURES)


def customer_snapshot(t: Mapping[str, DataFrame], *, cutoff: str | None = None, tenure_weeks: int | None = None, weeks: int | None = None) -> DataFrame:
    """A lifecycle world at one date for all, or ``tenure_weeks`` after each customer's start. Customers who hadn't started or had churned by then are left out.

    weeks: how many weeks each customer was simulated for, from its start; a cutoff whose targets, of up to TARGET_DAYS, would reach beyond that for any customer raises, as they would be cut short.
    """
    if (cutoff is None) == (tenure_weeks is None):
        raise SnapshotError("either a cutoff or a tenure is needed")
    who = t["customers"].join(t["subscriptions"].select("customer_id", "churn_at"), "customer_id")
    start = S.day_of(F.col("customer_start_at"))
    who = who.withColumns({"start": start, "cutoff": F.lit(cutoff).cast("date") if cutoff else F.date_add(start, tenure_weeks * 7), "churn": S.day_of(F.col("churn_at"))})
    who = who.where((F.col("start") <= F.col("cutoff")) & (F.col("churn").isNull() | (F.col("churn") > F.col("cutoff"))))
    low = high = F.lit(cutoff).cast("date")
    if weeks is not None or not cutoff:
        who = materialised(who)
        short = F.lit(False) if weeks is None else F.date_add("cutoff", TARGET_DAYS) > F.date_add("start", weeks * 7)
        found = who.agg(F.count_if(short).alias("n"), F.min(F.when(short, F.col("start"))).alias("start"), F.min("cutoff").alias("low"), F.max("cutoff").alias("high")).first()
        if found["n"]:
            raise SnapshotError(f"{weeks} weeks from {found['start']} on don't cover {TARGET_DAYS} days behind the cutoff; the targets of {found['n']} customers would be cut short")
        low, high = F.lit(found["low"]).cast("date"), F.lit(found["high"]).cast("date")
    pad = {"kind": "string", "ts": "string", "what": "string", "a": "long", "b": "double", "c": "long"}

    def rows(name: str, kind: str, ts: str, **values: Column) -> DataFrame:
        values |= {"kind": F.lit(kind), "ts": F.col(ts)}
        return t[name].select("customer_id", *(values.get(c, F.lit(None)).cast(d).alias(c) for c, d in pad.items()))

    # What no customer's cutoff can reach isn't shuffled.
    at = S.day_of(F.col("ts"))
    health = (at <= high) & ((at > F.date_sub(low, RECENT_DAYS)) | F.col("what").isNotNull())
    invoices = F.col("what").isin(*PAID) & (at > low) & (at <= F.date_add(high, TARGET_DAYS))
    events = (
        rows("subscription_events", "event", "event_timestamp", what=F.col("event_type"), a=F.col("mrr_after") - F.col("mrr_before"))
        .unionByName(rows("health_signals", "health", "period_start", a=F.col("active_users"), b=F.col("feature_depth_score"), c=F.col("support_tickets"), what=F.col("nps_score").cast("string")).where(health))
        .unionByName(rows("invoices", "invoice", "invoice_date", what=F.col("payment_status"), a=F.col("amount_usd")).where(invoices))
    )
    dated = events.join(who.select("customer_id", "cutoff"), "customer_id").withColumn("day", F.datediff(S.day_of(F.col("ts")), F.col("cutoff")))
    is_ = lambda kind, what=None: (F.col("kind") == kind) & (F.lit(True) if what is None else F.col("what") == what)
    past, grown = F.col("day") <= 0, F.when(is_("event", "expansion"), F.col("a"))
    lately = is_("health") & past & (F.col("day") > -RECENT_DAYS)
    paid = is_("invoice") & F.col("what").isin(*PAID)
    users = F.when(lately, F.col("a").cast("double"))
    per = dated.groupBy("customer_id").agg(
        F.coalesce(F.sum(F.when(past, grown)), F.lit(0)).alias("mrr_change_at_snapshot"), F.count_if(past & is_("event", "renewal")).alias("renewal_count"), F.count_if(past & is_("event", "expansion")).alias("expansion_count"),
        F.avg(users).alias("avg_active_users_l12w"), F.regr_slope(users, F.when(lately, F.col("day") / 7)).alias("active_user_trend_l12w"), F.avg(F.when(lately, F.col("b"))).alias("avg_feature_depth_l12w"), F.coalesce(F.sum(F.when(lately, F.col("c"))), F.lit(0)).alias("support_ticket_count_l12w"),
        F.max_by("what", F.when(is_("health") & past & F.col("what").isNotNull(), F.col("ts"))).alias("last_nps_score"), F.count_if(past & is_("event", "payment_failure")).alias("payment_failure_count"), F.floor(-F.max(F.when(past & is_("event", "payment_failure"), F.col("day"))) / 7).alias("weeks_since_last_payment_failure"),
        F.coalesce(F.sum(grown), F.lit(0)).alias("mrr_change_full_period"), *(F.sum(F.when(paid & (F.col("day") > 0) & (F.col("day") <= s), F.col("a")).otherwise(0)).alias(f"ltv_revenue_{s}d") for s in (90, 365, 730)),
    )
    out = who.drop("renewal_count", "expansion_count").join(per, "customer_id", "left")
    if "accounts" in t:
        out = out.join(t["accounts"].select("account_id", "industry", "region", "employee_band", "estimated_revenue_band"), "account_id", "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("string") for c in ("industry", "region", "employee_band", "estimated_revenue_band")})
    tenure = S.floor_weeks(F.datediff("cutoff", "start"))
    out = out.withColumn("tenure_weeks", tenure)
    churned = F.coalesce(F.col("churn") <= F.date_add("cutoff", 180), F.lit(False))
    zero = [f.name for f in CUSTOMER_FEATURES if f.name.endswith("_count") or f.name.startswith(("mrr_change", "ltv_", "support"))]
    out = out.fillna(0, zero).withColumns({"current_mrr": F.col("initial_mrr") + F.col("mrr_change_at_snapshot"), "weeks_to_next_renewal": S.next_renewal_week(F.col("tenure_weeks"), F.col("contract_term_months")) - F.col("tenure_weeks"), "churned_within_180d": churned})
    return catalogue(out, CUSTOMER_FEATURES)
