"""Lead worlds as column expressions: population, funnel and events, without a loop over days.

Nothing that happens to a lead feeds back into its hazards, so its history is a set of waiting times: days until churn, days in each stage, days until
it closes or converts directly. Events then come from exploding its days. Every draw is keyed by the entity, so any partitioning gives the same world.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.random import choice, fast_uniform, geometric, normal, poisson
from ..functions.scalars import clipped, entity_id, mapped, padded, sigmoid
from ..sources.tables import materialised
from . import motifs as V

BASE_DATE = "2024-01-01"
INDUSTRIES = ("software", "manufacturing", "healthcare", "finance", "logistics", "retail")
REGIONS = ("north_america", "europe", "apac", "latam")
ROLES = ("finance", "operations", "it", "procurement", "executive")
CHANNELS = {"inbound_marketing": 0.45, "sdr_outbound": 0.35, "partner_referral": 0.20}
SALES_STAGES = ("sql", "demo_scheduled", "demo_completed", "proposal_sent", "negotiation")


@dataclass(frozen=True)
class LeadWorld:
    """What a lead world is made of. ``target_rate``: (low, high) of the wanted conversion rate, with ``signal`` as the strength of the latent weights."""

    seed: int = 42
    motif: str = "fit_dominant"
    n_accounts: int = 1500
    n_contacts: int = 4200
    n_leads: int = 5000
    horizon_days: int = 90
    label_days: int = 90
    target_rate: tuple[float, float] | None = None
    signal: float = 1.0
    committee_friction: float = 0.0

    def __post_init__(self) -> None:
        if self.motif not in V.CONVERSION:
            raise ValueError(f"unknown motif {self.motif!r}")
        if not 0 < self.label_days <= self.horizon_days:
            raise ValueError("label_days must be within the horizon")
        if min(self.n_accounts, self.n_contacts, self.n_leads) < 1:
            raise ValueError("a world needs accounts, contacts and leads")

    def hazard(self) -> tuple[float, float]:
        base, scale = V.HAZARD[self.motif]
        if self.target_rate is None:
            return base, scale
        reach, days = V.REACH[self.motif]
        daily = 1 - (1 - min(0.92, sum(self.target_rate) / 2 / reach)) ** (1 / days)
        return daily * base / (base + scale), daily * scale / (base + scale)

    def weights(self, table: Mapping[str, Mapping[str, float]]) -> dict[str, float]:
        """Latent weights; a weaker signal weakens all but the strongest more."""
        own = dict(table[self.motif])
        if self.signal >= 1:
            return own
        top = max(abs(w) for w in own.values())
        return {k: w * (self.signal if abs(w) >= top else self.signal**1.5) for k, w in own.items()}


def pick(u: Column, values: Sequence[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def population(spark: SparkSession, world: LeadWorld) -> dict[str, DataFrame]:
    """accounts, contacts and leads; leads carry their merged latent traits as latent_<trait>."""
    u = lambda stream, key: fast_uniform(world.seed, stream, F.col(key))
    accounts = spark.range(1, world.n_accounts + 1).withColumnRenamed("id", "account_no")
    maturity = choice(u("maturity", "account_no"), V.MATURITY)
    accounts = accounts.select(
        "account_no", entity_id("acct", F.col("account_no")).alias("account_id"), F.concat(F.lit("Company "), F.col("account_no")).alias("company_name"), pick(u("industry", "account_no"), INDUSTRIES).alias("industry"),
        pick(u("region", "account_no"), REGIONS).alias("region"), choice(u("employees", "account_no"), V.EMPLOYEES).alias("employee_band"), choice(u("revenue", "account_no"), V.REVENUE).alias("estimated_revenue_band"),
        maturity.alias("process_maturity_band"), F.lit(BASE_DATE).alias("created_at"),
    )
    contacts = spark.range(1, world.n_contacts + 1).withColumnRenamed("id", "contact_no")
    contacts = contacts.select(
        "contact_no", entity_id("cont", F.col("contact_no")).alias("contact_id"), (F.floor(u("contact_account", "contact_no") * world.n_accounts) + 1).alias("account_no"), pick(u("role", "contact_no"), ROLES).alias("role_function"),
        choice(u("seniority", "contact_no"), V.SENIORITY).alias("seniority"), pick(u("buyer", "contact_no"), ("champion", "economic_buyer", "end_user")).alias("buyer_role"), choice(u("email", "contact_no"), V.EMAIL).alias("email_domain_type"), F.lit(BASE_DATE).alias("created_at"),
    )
    leads = spark.range(1, world.n_leads + 1).withColumnRenamed("id", "lead_no").withColumn("contact_no", F.floor(u("lead_contact", "lead_no") * world.n_contacts) + 1)
    # Parents are functions of their number, so a lead knows its account without a join.
    leads = leads.withColumn("account_no", F.floor(u("contact_account", "contact_no") * world.n_accounts) + 1)
    shift = V.LATENT_SHIFT[world.motif]
    owner = {"account_fit": "account_no", "budget_readiness": "account_no", "process_maturity": "account_no", "contact_authority": "contact_no", "responsiveness": "contact_no", "problem_awareness": "contact_no"}
    mean = {t: F.lit(0.5 + shift.get(t, 0.0)) for t in V.LEAD_TRAITS}
    mean["process_maturity"] = mapped(choice(fast_uniform(world.seed, "maturity", F.col("account_no")), V.MATURITY), V.MATURITY_MEAN, 0.5)
    traits = {f"latent_{t}": clipped(mean[t] + 0.15 * normal(world.seed, f"latent:{t}", F.col(owner.get(t, "lead_no"))), 0.0, 1.0) for t in V.LEAD_TRAITS}
    leads = leads.select(
        "lead_no", entity_id("lead", F.col("lead_no")).alias("lead_id"), entity_id("cont", F.col("contact_no")).alias("contact_id"), entity_id("acct", F.col("account_no")).alias("account_id"),
        F.date_format(F.date_add(F.lit(BASE_DATE).cast("date"), F.floor(u("created", "lead_no") * 30).cast("int")), "yyyy-MM-dd").alias("lead_created_at"), choice(u("channel", "lead_no"), CHANNELS).alias("first_touch_channel"),
        entity_id("rep", F.floor(u("rep", "lead_no") * 10) + 1).alias("owner_rep_id"), choice(fast_uniform(world.seed, "employees", F.col("account_no")), V.EMPLOYEES).alias("employee_band"), *(c.alias(n) for n, c in traits.items()),
    )
    contacts = contacts.withColumn("account_id", entity_id("acct", F.col("account_no"))).drop("account_no", "contact_no")
    return {"accounts": accounts.drop("account_no"), "contacts": contacts, "leads": leads}


def score(weights: Mapping[str, float], bias: float) -> Column:
    total = F.lit(bias)
    for trait, w in weights.items():
        total = total + w * F.col(f"latent_{trait}")
    return sigmoid(total)


def histories(leads: DataFrame, world: LeadWorld) -> DataFrame:
    """leads with the day each stage is entered (day_<stage>), churn_day, convert_day, last_day and final_stage."""
    key = F.col("lead_no")
    wait = lambda p, stream: geometric(p, fast_uniform(world.seed, stream, key))
    base, scale = world.hazard()
    advance = clipped(0.05 + 0.15 * score(world.weights(V.TRANSITION), -1.0), 0.0, 0.25)
    close = clipped(base + scale * score(world.weights(V.CONVERSION), -1.5), 0.0, 1.0)
    out = leads.withColumns({"p_advance": advance, "p_close": close, "day_mql": F.lit(0)})
    for before, stage in zip(V.STAGES, V.STAGES[1:], strict=False):
        # Two days of dwelling; the first day that can bring the next stage is the second after entering.
        out = out.withColumn(f"day_{stage}", F.col(f"day_{before}") + 1 + wait(F.col("p_advance"), f"stage:{stage}"))
    out = out.withColumn("churn_day", wait(F.lit(V.DAILY_CHURN * (1 + 0.5 * world.committee_friction)), "churn") - 1)
    direct = wait(F.col("p_close") * V.DIRECT_SHARE, "direct") - 1
    closed = F.col("day_negotiation") + wait(F.col("p_close"), "close")
    out = out.withColumn("wins", F.least(F.when(direct < F.col("day_sql"), direct), closed))
    # On one day churn comes before conversion.
    out = out.withColumn("convert_day", F.when((F.col("wins") < F.col("churn_day")) & (F.col("wins") < world.horizon_days), F.col("wins")))
    out = out.withColumn("churn_day", F.when(F.col("convert_day").isNull() & (F.col("churn_day") < world.horizon_days), F.col("churn_day")))
    out = out.withColumn("last_day", F.coalesce("convert_day", F.col("churn_day") - 1, F.lit(world.horizon_days - 1)))
    reached = F.lit("mql")
    for stage in V.STAGES[1:]:
        reached = F.when(F.col(f"day_{stage}") <= F.col("last_day"), stage).otherwise(reached)
    final = F.when(F.col("convert_day").isNotNull(), "closed_won").when(F.col("churn_day").isNotNull(), "closed_lost").otherwise(reached)
    return out.withColumns({"final_stage": final, "sql_day": F.when(F.col("day_sql") <= F.col("last_day"), F.col("day_sql"))}).drop("wins", "p_advance")


def days(history: DataFrame, world: LeadWorld) -> DataFrame:
    """One row per lead and day on which it is active, with its stage at the end of that day and its number of touches."""
    per = history.where("last_day >= 0").withColumn("day", F.explode(F.sequence(F.lit(0), F.col("last_day"))))
    stage = F.lit("mql")
    for s in V.STAGES[1:]:
        stage = F.when(F.col("day") >= F.col(f"day_{s}"), s).otherwise(stage)
    stage = F.when(F.col("day") == F.col("convert_day"), "closed_won").otherwise(stage)
    rate = F.greatest(F.lit(0.02), V.TOUCH_RATE[world.motif] * F.pow(F.lit(0.97), F.col("day")) * F.exp(1.2 * (F.col("latent_engagement_propensity") - 0.5)))
    at = F.date_format(F.date_add(F.col("lead_created_at").cast("date"), F.col("day")), "yyyy-MM-dd")
    return per.withColumns({"stage": stage, "at": at, "n_touches": poisson(rate, fast_uniform(world.seed, "touches", F.col("lead_no"), F.col("day")), 12)})


def _draw(world: LeadWorld, stream: str, index: Column | None = None) -> Column:
    at = F.col("day") if index is None else F.col("day") * 100 + index
    return fast_uniform(world.seed, stream, F.col("lead_no"), at)


def _integer(u: Column, low: int, high: int) -> Column:
    return (F.floor(u * (high - low + 1)) + low).cast("long")


def simulate(spark: SparkSession, world: LeadWorld) -> dict[str, DataFrame]:
    """All tables of a lead world. Event ids are built from the lead, the day and the place on that day."""
    made = population(spark, world)
    # Leads and their histories are read by six tables; their expressions are deep, so they are computed once.
    history = materialised(histories(materialised(made["leads"], wide=True), world), wide=True)
    active = days(history, world)
    event_id = lambda prefix, *parts: F.concat_ws("_", F.lit(prefix), padded(F.col("lead_no"), 9), padded(F.col("day"), 3), *parts)
    touch = active.where("n_touches > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_touches"))))
    touches = touch.select(
        event_id("touch", padded(F.col("k"), 2)).alias("touch_id"), "lead_id", F.col("at").alias("touch_timestamp"), pick(_draw(world, "touch_type", F.col("k")), V.TOUCH_TYPES).alias("touch_type"),
        F.col("first_touch_channel").alias("touch_channel"), F.when(F.col("first_touch_channel") == "inbound_marketing", "inbound").otherwise("outbound").alias("touch_direction"), F.lit(None).cast("string").alias("campaign_id"),
    )
    late = F.col("stage").isin(*SALES_STAGES)
    sessions = active.where((F.col("n_touches") > 0) & (_draw(world, "session") < 0.30)).select(
        event_id("sess").alias("session_id"), "lead_id", F.col("at").alias("session_timestamp"), pick(_draw(world, "session_type"), V.SESSION_TYPES).alias("session_type"), _integer(_draw(world, "page_views"), 1, 10).alias("page_views"),
        F.when(late | (F.col("stage") == "closed_won"), _integer(_draw(world, "pricing"), 0, 2)).otherwise(0).alias("pricing_page_views"), F.when(F.col("stage").isin("demo_scheduled", "demo_completed"), _integer(_draw(world, "demo"), 0, 2)).otherwise(0).alias("demo_page_views"),
        _integer(_draw(world, "duration"), 60, 600).alias("session_duration_seconds"),
    )
    activities = active.where(late & (_draw(world, "activity") < 0.20)).select(
        event_id("act").alias("activity_id"), "lead_id", F.col("owner_rep_id").alias("rep_id"), F.col("at").alias("activity_timestamp"), pick(_draw(world, "activity_type"), V.ACTIVITY_TYPES).alias("activity_type"), pick(_draw(world, "outcome"), V.OUTCOMES).alias("activity_outcome"),
    )
    on = lambda d: F.date_format(F.date_add(F.col("lead_created_at").cast("date"), d), "yyyy-MM-dd")
    leads = history.select(
        "lead_id", "contact_id", "account_id", "lead_created_at", F.col("first_touch_channel").alias("lead_source"), "first_touch_channel", F.col("final_stage").alias("current_stage"), "owner_rep_id", F.col("sql_day").isNotNull().alias("is_sql"),
        F.coalesce(F.col("convert_day") <= world.label_days, F.lit(False)).alias("converted_within_90_days"), on(F.col("convert_day")).alias("conversion_timestamp"),
    )
    made_day = F.coalesce("sql_day", "convert_day")
    low = mapped(F.col("employee_band"), {"200-499": 15_000.0, "500-999": 30_000.0, "1000-1999": 50_000.0, "2000+": 90_000.0}, 30_000.0)
    acv = (F.round(low * (1 + 1.5 * fast_uniform(world.seed, "acv", F.col("lead_no"))))).cast("long")
    won, lost = F.col("final_stage") == "closed_won", F.col("final_stage") == "closed_lost"
    opened = history.where(made_day.isNotNull()).withColumn("opportunity_id", F.concat(F.lit("opp_"), F.substring("lead_id", 6, 20)))
    opportunities = opened.select(
        "opportunity_id", "lead_id", on(made_day).alias("created_at"), F.col("final_stage").alias("stage"), acv.alias("estimated_acv"), F.when(won, "won").when(lost, "lost").alias("close_outcome"), on(F.when(won, F.col("convert_day")).when(lost, F.col("churn_day"))).alias("closed_at"),
    )
    bought = opened.where(won).withColumn("customer_id", F.concat(F.lit("cust_"), F.substring("lead_id", 6, 20)))
    customers = bought.select("customer_id", "opportunity_id", "account_id", on(F.col("convert_day")).alias("customer_start_at"))
    plan = F.when(acv < 30_000, "starter").when(acv < 80_000, "growth").otherwise("enterprise")
    subscriptions = bought.select(F.concat(F.lit("sub_"), F.substring("lead_id", 6, 20)).alias("subscription_id"), "customer_id", plan.alias("plan_name"), on(F.col("convert_day")).alias("subscription_start_at"), F.lit("active").alias("subscription_status"))
    return {"accounts": made["accounts"], "contacts": made["contacts"], "leads": leads, "touches": touches, "sessions": sessions, "sales_activities": activities, "opportunities": opportunities, "customers": customers, "subscriptions": subscriptions}
