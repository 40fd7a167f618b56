"""Queries over simulated worlds, hazards and models. Worlds have as many entities as the test tables have customers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..generate import graph, leads, lifecycle, motifs
from ..operators import models as M
from ..operators import flat, quality, resampling, sampling, snapshots
from ..operators import ranking as R
from ..sources.tables import read_table
from .audits import u_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS week, CAST(min(CASE WHEN round_even(k * t * 13 / 3.0, 0) > p_size THEN round_even(k * t * 13 / 3.0, 0) END) AS BIGINT) AS next_week, bool_or(k >= 1 AND round_even(k * t * 13 / 3.0, 0) = p_size) AS is_renewal FROM (SELECT p_partkey, p_size, CASE p_partkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 6 ELSE 12 END AS t FROM part), range(0, 30) r(k) GROUP BY p_partkey, p_size")
def renewal_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Contract anniversaries: part sizes as weeks, terms of 3, 6 and 12 months."""
    part = read_table(spark, d, "part", ["p_partkey", "p_size"])
    term = F.when(F.col("p_partkey") % 3 == 0, 3).when(F.col("p_partkey") % 3 == 1, 6).otherwise(12)
    return part.select("p_partkey", F.col("p_size").cast("long").alias("week"), S.next_renewal_week(F.col("p_size"), term).cast("long").alias("next_week"), S.is_renewal_week(F.col("p_size"), term).alias("is_renewal"))


@query("WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN (c_acctbal % 1000) / 1000 END AS fit, (c_nationkey % 10) / 10.0::DOUBLE AS champion, c_custkey % 60 AS week FROM customer) SELECT c_custkey, round(1 / (1 + exp(-(2.0 * coalesce(fit, 0.5) - 1.5))), 6) AS score, round(exp(-2.0 * (coalesce(fit, 0.5) - 0.5) - 0.5 * (champion - 0.5)), 6) AS factor, round(least(0.95, 0.0034 * exp(-2.0 * (coalesce(fit, 0.5) - 0.5) - 0.5 * (champion - 0.5)) * (1 + 1.5 * exp(-week / 4.0))), 8) AS churn, round(tanh(champion / 0.3), 6) AS saturated, round(0.4 * exp(-ln(2) * week / 14.0), 6) AS decayed, round(0.2 + 0.8 * least(1.0, greatest(0.0, week / 10.0)), 6) AS ramped, CASE WHEN champion >= 0.5 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS stepped FROM c")
def hazard_scores(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer", ["c_custkey", "c_acctbal", "c_nationkey"])
    rows = c.select("c_custkey", F.when(F.col("c_acctbal") > 0, (F.col("c_acctbal") % 1000) / 1000).alias("fit"), ((F.col("c_nationkey") % 10) / 10).alias("champion"), (F.col("c_custkey") % 60).alias("week"))
    factor = S.cox_factor({"fit": -2.0, "champion": -0.5})
    onboarding = 1 + (motifs.ONBOARDING_PEAK - 1) * F.exp(-F.col("week") / motifs.ONBOARDING_WEEKS)
    return rows.select(
        "c_custkey", F.round(S.sigmoid(2.0 * F.coalesce("fit", F.lit(0.5)) - 1.5), 6).alias("score"), F.round(factor, 6).alias("factor"), F.round(F.least(F.lit(motifs.MOST), 0.0034 * factor * onboarding), 8).alias("churn"),
        F.round(S.saturating(F.col("champion"), 0.3), 6).alias("saturated"), F.round(S.decayed(F.lit(0.4), F.col("week"), 14.0), 6).alias("decayed"), F.round(S.ramp(F.col("week"), 10.0, 0.2), 6).alias("ramped"), S.thresholded(F.col("champion"), 0.5, 0.1, 1.0).alias("stepped"),
    )


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 2500 THEN 'low' WHEN c_acctbal < 7500 THEN 'middle' ELSE 'high' END AS band FROM customer")
def band_map(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "customer", ["c_custkey", "c_acctbal"]).select("c_custkey", S.band(F.col("c_acctbal"), [(0, "debt"), (2500, "low"), (7500, "middle")], "high").alias("band"))


@query("SELECT c_custkey, 'cust_' || CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 6 THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') ELSE CAST(c_custkey AS VARCHAR) END AS id FROM customer")
def make_ids(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "customer", ["c_custkey"]).select("c_custkey", S.entity_id("cust", F.col("c_custkey")).alias("id"))


def _n(spark: SparkSession, d: str) -> int:
    return read_table(spark, d, "customer", ["c_custkey"]).count()


def lead_world(spark: SparkSession, d: str) -> leads.LeadWorld:
    n = _n(spark, d)
    return leads.LeadWorld(motif="fit_dominant", n_accounts=n, n_contacts=3 * n, n_leads=3 * n)


@query()
def population(spark: SparkSession, d: str) -> DataFrame:
    return leads.population(spark, lead_world(spark, d))["leads"]


@query()
def lead_simulation(spark: SparkSession, d: str) -> DataFrame:
    """All touches of a simulated lead world."""
    return leads.simulate(spark, lead_world(spark, d))["touches"]


@query()
def lead_world_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.lead_snapshot(leads.simulate(spark, lead_world(spark, d)), window=30)


@query()
def flat_dataset(spark: SparkSession, d: str) -> DataFrame:
    world = lead_world(spark, d)
    return flat.flat_dataset(snapshots.lead_snapshot(leads.simulate(spark, world), window=30), flat.Flat(n=world.n_leads // 10, rate=0.3))


@query()
def lifecycle_simulation(spark: SparkSession, d: str) -> DataFrame:
    """All subscription events of a simulated customer world."""
    return lifecycle.simulate(spark, lifecycle.LifecycleWorld(n_customers=_n(spark, d)))["subscription_events"]


@query()
def customer_world_snapshot(spark: SparkSession, d: str) -> DataFrame:
    cutoff, world = "2023-06-05", lifecycle.LifecycleWorld(n_customers=_n(spark, d))
    seen = (date.fromisoformat(cutoff) - date.fromisoformat(world.start)).days // 7 + 1  # no one starts before the world does
    return snapshots.customer_snapshot(lifecycle.simulate(spark, world, health_weeks=seen), cutoff=cutoff, weeks=world.weeks)


@query()
def customer_early_snapshot(spark: SparkSession, d: str) -> DataFrame:
    tenure, world = 4, lifecycle.LifecycleWorld(n_customers=_n(spark, d))
    return snapshots.customer_snapshot(lifecycle.simulate(spark, world, health_weeks=tenure + 1), tenure_weeks=tenure, weeks=world.weeks)


@query()
def hidden_graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.sample("fit_dominant", 42).frames(spark)[1]


def _orders(spark: SparkSession, d: str, *more: str) -> DataFrame:
    o = read_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate", "o_orderstatus"])
    return o.select("o_orderkey", "o_totalprice", "o_orderpriority", F.month("o_orderdate").alias("month"), (F.col("o_custkey") % 7).alias("group"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), *more)


@query()
def lr_probe(spark: SparkSession, d: str) -> DataFrame:
    """Cross-validated scores of a linear model."""
    return M.cross_validated(_orders(spark, d), "o_orderkey", ["o_totalprice", "o_orderpriority", "month", "group"], "y", "lr")


@query(f"WITH r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders) SELECT o_orderkey, y, CAST((row_number() OVER (PARTITION BY y ORDER BY {u_sql('folds', 'o_orderkey', seed=42)}, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM r")
def fold_assign(spark: SparkSession, d: str) -> DataFrame:
    """The folds of the cross-validation."""
    return M.stratified_folds(_orders(spark, d).select("o_orderkey", "y"), "o_orderkey", "y", 5, 42)


@query()
def subset_probe(spark: SparkSession, d: str) -> DataFrame:
    """AUC of a model that sees the order's month and group only."""
    train, test = M.held_out(_orders(spark, d), "o_orderkey", 0.3, 42, "y")
    return R.roc_auc(M.fit_predict(train, test, ["month", "group"], "y", "gbt"))


@query()
def tier_panel(spark: SparkSession, d: str) -> DataFrame:
    """Both models' metrics on a stratified hold-out."""
    train, test = M.held_out(_orders(spark, d), "o_orderkey", 0.3, 42, "y")
    return quality.panel(train, test, ["o_totalprice", "o_orderpriority", "month", "group"], "y", "o_orderkey")


@query()
def cohort_shift(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders(spark, d, "o_orderdate")
    return quality.cohort_shift(rows, "o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")), ["o_totalprice", "o_orderpriority", "month", "group"], "y")


@query()
def gbt_probe(spark: SparkSession, d: str) -> DataFrame:
    train, test = M.held_out(_orders(spark, d), "o_orderkey", 0.3, 42)
    return M.fit_predict(train, test, ["o_totalprice", "o_orderpriority", "month", "group"], "y", "gbt", ["o_orderkey"])


@query()
def id_only_probe(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders(spark, d).select("o_orderkey", "y", *M.hashed_id(F.col("o_orderkey")))
    train, test = M.held_out(rows, "o_orderkey", 0.3, 42)
    return M.fit_predict(train, test, [c for c in rows.columns if c.startswith("h")], "y", "lr", ["o_orderkey"])


@query()
def trap_delta(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders(spark, d)
    rows = rows.withColumn("leak", sampling.trap(F.lit(0), F.col("y"), sampling.fast_uniform(7, "trap", F.col("o_orderkey"))).cast("double"))
    return M.trap_delta(rows, "o_orderkey", ["o_totalprice", "month"], "leak", "y")


@query()
def hist_gbt_probe(spark: SparkSession, d: str) -> DataFrame:
    """Held-out scores of boosted trees over orders with gaps in three columns, without anything put in for them."""
    gap = lambda c, share: F.when(sampling.fast_uniform(11, f"gap:{c}", F.col("o_orderkey")) >= share, F.col(c)).alias(c)
    rows = _orders(spark, d).select("o_orderkey", "y", gap("o_totalprice", 0.2), gap("o_orderpriority", 0.1), gap("month", 0.3), "group")
    train, test = M.held_out(rows, "o_orderkey", 0.3, 42)
    return M.hist_gbt(train, test, ["o_totalprice", "o_orderpriority", "month", "group"], "y", ["o_orderkey"])


@query()
def trap_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Whether a column that is raised with the label adds enough, with every seed."""
    return M.trap_verdicts(trap_delta(spark, d), 0.02, 0.0)


_P1 = "CASE " + " ".join(f"WHEN u < '{x}' THEN {k}" for k, x in enumerate(sampling.POISSON_1)) + f" ELSE {len(sampling.POISSON_1)} END"


@query("WITH d AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, b, md5('7:bootstrap:' || o_orderkey || ':' || b) AS h FROM orders, range(0, 50) g(b)), w AS (SELECT 4 * b + k AS replicate, y, substr(h, CAST(8 * k + 1 AS BIGINT), 8) AS u FROM d, range(0, 4) r(k)), m AS (SELECT sum(" + _P1 + " * y) / sum(" + _P1 + ") AS m FROM w GROUP BY replicate) SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.5), 6) AS median, round(quantile_cont(m, 0.975), 6) AS high FROM m")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    out = sampling.bootstrap(_orders(spark, d), "o_orderkey", F.col("y"), replicates=200, seed=7)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


_BOOT = (
    "WITH d AS (SELECT o_totalprice, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS urgency, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, b, md5('7:bootstrap:' || o_orderkey || ':' || b) AS h FROM orders, range(0, 50) g(b)), "
    "u AS (SELECT 4 * b + k AS replicate, o_totalprice, urgency, y, substr(h, CAST(8 * k + 1 AS BIGINT), 8) AS u FROM d, range(0, 4) r(k)), "
    "w AS (SELECT replicate, s.score, s.p, y, " + _P1 + " AS w FROM u, unnest([{'score': 'price', 'p': o_totalprice}, {'score': 'urgency', 'p': urgency}]) t(s)), "
    "g AS (SELECT score, replicate, p, sum(w * y)::DOUBLE AS pos, sum(w * (1 - y))::DOUBLE AS neg FROM w GROUP BY ALL), "
    "c AS (SELECT *, sum(pos) OVER o AS cp, sum(neg) OVER o AS cn, sum(pos) OVER a AS ap, sum(neg) OVER a AS an FROM g WINDOW o AS (PARTITION BY score, replicate ORDER BY p DESC), a AS (PARTITION BY score, replicate)), "
    "m AS (SELECT score, replicate, sum(neg * (cp - pos / 2)) / nullif(max(ap) * max(an), 0) AS auc, CASE WHEN max(ap) * max(an) > 0 THEN sum(CASE WHEN pos > 0 THEN pos / ap * (cp / (cp + cn)) ELSE 0 END) END AS average_precision FROM c GROUP BY ALL), "
    "f AS (SELECT * FROM m UNION ALL SELECT 'urgency - price', replicate, b.auc - a.auc, b.average_precision - a.average_precision FROM m a JOIN m b USING (replicate) WHERE a.score = 'price' AND b.score = 'urgency'), "
    "l AS (UNPIVOT f ON auc, average_precision INTO NAME metric VALUE v) "
    "SELECT score, metric, count(v) AS replicates, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75, round(quantile_cont(v, 0.975), 6) AS high FROM l GROUP BY ALL"
)


@query(_BOOT)
def bootstrap_auc(spark: SparkSession, d: str) -> DataFrame:
    """Bands of the AUC and average precision of two scores of all orders, one almost without ties and one of five values, and of their differences over the same resamples."""
    rows = read_table(spark, d, "orders", ["o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"])
    rows = rows.select("o_orderkey", F.col("o_totalprice").alias("price"), F.substring("o_orderpriority", 1, 1).cast("double").alias("urgency"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    out = resampling.bootstrap_ranked(rows, "o_orderkey", ["price", "urgency"], "y", replicates=200, seed=7)
    return out.select("score", "metric", "replicates", *(F.round(c, 6).alias(c) for c in resampling.SUMMARY))
