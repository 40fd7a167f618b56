"""Queries on the quality of datasets: orders as leads, priorities as tiers, fifths as seeds, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.random import uniform
from ..operators import audit as A
from ..operators import quality as Q
from ..operators import sampling as M
from ..sources.tables import read_table
from .audits import _SPLIT, SEED, split_orders, u_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Priorities that stand for tiers, easiest first.
TIERS = ("1-URGENT", "3-MEDIUM", "5-LOW")
RANGES = (("1-URGENT", 0.40, 0.60), ("3-MEDIUM", 0.10, 0.20), ("5-LOW", 0.30, 0.45))


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


_Y = "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END"
_METRICS = f"""WITH s AS (SELECT o_orderpriority AS tier, CAST(floor({u_sql('run', 'o_orderkey')} * 5) AS INTEGER) AS seed, {_Y} AS y, o_totalprice AS v FROM orders),
m AS (SELECT tier, seed, 'rate' AS metric, avg(y) AS value FROM s GROUP BY ALL UNION ALL SELECT tier, seed, 'won', sum(y * v) / sum(v) FROM s GROUP BY ALL),
c AS (SELECT tier, metric, count(*) AS n_seeds, round(quantile_cont(value, 0.5), 6) AS median, round(max(value) - min(value), 6) AS spread FROM m GROUP BY ALL)"""


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "orders", ["o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"])
    y, seed = (F.col("o_orderstatus") == "F").cast("int"), F.floor(uniform(SEED, "run", F.col("o_orderkey")) * 5).cast("int")
    per = rows.groupBy(F.col("o_orderpriority").alias("tier"), seed.alias("seed")).agg(F.avg(y).alias("rate"), F.try_divide(F.sum(y * F.col("o_totalprice")), F.sum("o_totalprice")).alias("won"))
    out = Q.across_seeds(per.unpivot(["tier", "seed"], ["rate", "won"], "metric", "value"))
    return out.withColumns({c: F.round(c, 6) for c in ("median", "spread")})


@query(_METRICS + " SELECT * FROM c")
def cross_seed_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Medians and spreads over seeds."""
    return _seeds(spark, d)


@query(_METRICS + f""", t AS (SELECT *, list_position({list(TIERS)!r}, tier) AS hard FROM c WHERE tier IN {TIERS!r})
SELECT metric, tier, median, rank() OVER (PARTITION BY metric ORDER BY median DESC) AS place, median > lead(median) OVER (PARTITION BY metric ORDER BY hard) AS above_next FROM t""")
def cross_tier_order(spark: SparkSession, d: str) -> DataFrame:
    return Q.tier_order(_seeds(spark, d), TIERS)


@query(f"WITH r AS (SELECT o_orderpriority AS tier, round(avg({_Y}), 6) AS rate FROM orders GROUP BY 1), b(tier, low, high) AS (VALUES " + ", ".join(f"('{t}', {lo}::DOUBLE, {hi}::DOUBLE)" for t, lo, hi in RANGES) + ") SELECT tier, rate, low, high FROM r JOIN b USING (tier) WHERE rate < low - 0.02 OR rate > high + 0.02")
def tier_rate_ranges(spark: SparkSession, d: str) -> DataFrame:
    rates = read_table(spark, d, "orders", ["o_orderpriority", "o_orderstatus"]).groupBy(F.col("o_orderpriority").alias("tier")).agg(F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("rate"))
    return Q.out_of_range(rates, spark.createDataFrame(list(RANGES), "tier string, low double, high double"), 0.02)


def _crm(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """customers as leads, orders as opportunities, large orders as customers, their lines as subscriptions."""
    orders = read_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"])
    return {
        "leads": read_table(spark, d, "customer", ["c_custkey"]).select(F.col("c_custkey").alias("lead_id")),
        "opportunities": orders.select(F.col("o_orderkey").alias("opportunity_id"), F.col("o_custkey").alias("lead_id"), F.col("o_totalprice").alias("estimated_acv"), "o_orderstatus"),
        "customers": orders.where("o_totalprice > 350000").select(F.col("o_orderkey").alias("customer_id"), F.col("o_orderkey").alias("opportunity_id")),
        "subscriptions": read_table(spark, d, "lineitem", ["l_orderkey"]).select(F.col("l_orderkey").alias("customer_id")),
    }


@query("""WITH o AS (SELECT o_custkey AS lead_id, count(*) AS n_opps, max(o_totalprice) AS max_acv, sum(o_totalprice) AS total_acv, count(*) FILTER (WHERE o_totalprice > 350000) AS n_customers FROM orders GROUP BY 1),
l AS (SELECT o_custkey AS lead_id, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 350000 GROUP BY 1)
SELECT c_custkey AS lead_id, coalesce(n_opps, 0)::DOUBLE AS n_opps, coalesce(max_acv, 0)::DOUBLE AS max_acv, round(coalesce(total_acv, 0), 2)::DOUBLE AS total_acv, coalesce(n_customers, 0)::DOUBLE AS n_customers, coalesce(n, 0)::DOUBLE AS n_subscriptions
FROM customer LEFT JOIN o ON o.lead_id = c_custkey LEFT JOIN l ON l.lead_id = c_custkey""")
def relational_features(spark: SparkSession, d: str) -> DataFrame:
    """What a lead's joined tables tell about it."""
    t = _crm(spark, d)
    out = A.relational_features(t["leads"], t["opportunities"], t["customers"], t["subscriptions"])
    return out.withColumn("total_acv", F.round(F.col("mean_acv") * F.col("n_opps"), 2)).drop("mean_acv")  # a mean's last digit depends on the order of its rows


@query()
def relational_probe(spark: SparkSession, d: str) -> DataFrame:
    """Cross-validated AUC of a model of relational_features() for a label by hash, which nothing should tell."""
    from ..operators import models, ranking

    t = _crm(spark, d)
    rows = A.relational_features(t["leads"], t["opportunities"], t["customers"], t["subscriptions"]).withColumn("y", (uniform(SEED, "coin", F.col("lead_id")) < 0.5).cast("int"))
    return ranking.roc_auc(models.cross_validated(rows, "lead_id", [c for c in rows.columns if c not in ("lead_id", "y")], "y", "lr"))


@query(_SPLIT + f""", e AS (SELECT o_orderkey % 400 AS k, split, {_Y} AS y, round_even(o_totalprice / 50000, 1) AS p FROM s), a AS (SELECT user_id, CAST(min(ts) AS DATE) AS anchor FROM events GROUP BY 1),
lr AS (SELECT split, avg(y) AS rate FROM e GROUP BY 1), w AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 350000)
SELECT 'orphans' AS probe, 'orders.o_custkey -> customer' AS detail, count(DISTINCT o_custkey) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal <= 0 HAVING n > 0
UNION ALL SELECT 'late_events', 'events', count(*) FILTER (WHERE CAST(ts AS DATE) - anchor > 20) FROM events JOIN a USING (user_id)
UNION ALL SELECT 'split_overlap', x.split || ' ' || z.split, count(*) FROM (SELECT DISTINCT k, split FROM e) x JOIN (SELECT DISTINCT k, split FROM e) z ON x.k = z.k AND x.split < z.split GROUP BY 2
UNION ALL SELECT 'near_duplicates', x.split || ' ' || z.split, count(*) FROM (SELECT DISTINCT p, split FROM e) x JOIN (SELECT DISTINCT p, split FROM e) z ON x.p = z.p AND x.split < z.split GROUP BY 2
UNION ALL SELECT 'label_drift', x.split || ' ' || z.split, CAST(floor(abs(x.rate - z.rate) * 1000) AS BIGINT) FROM lr x JOIN lr z ON x.split < z.split WHERE abs(x.rate - z.rate) > 0.001
UNION ALL SELECT 'reconstruction', 'path_won', count(DISTINCT o_custkey) FROM w JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT 'reconstruction', 'path_customer', count(*) FROM b JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT 'reconstruction', 'path_subscription', count(DISTINCT o_custkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 350000
UNION ALL SELECT 'banned_column', 'customer.c_acctbal', 1""")
def probe_findings(spark: SparkSession, d: str) -> DataFrame:
    """All probes at once over tables that were tampered with."""
    crm = _crm(spark, d)
    orders, customer = read_table(spark, d, "orders", ["o_orderkey", "o_custkey"]), read_table(spark, d, "customer", ["c_custkey", "c_acctbal"])
    events = read_table(spark, d, "events", ["user_id", "ts"])
    day = F.datediff(F.to_date("ts"), F.col("anchor"))
    anchored = events.join(events.groupBy("user_id").agg(F.to_date(F.min("ts")).alias("anchor")), "user_id")
    rows = split_orders(spark, d, "o_totalprice", "o_orderstatus").select((F.col("o_orderkey") % 400).alias("k"), "split", (F.col("o_orderstatus") == "F").alias("y"), (F.col("o_totalprice") / 50000).alias("p"))
    return Q.findings({
        "orphans": lambda: Q.missing_parents([("orders", orders, "o_custkey", "customer", customer.where("c_acctbal > 0"), "c_custkey")]),
        "late_events": lambda: Q.late_events({"events": (anchored, "user_id", day)}, 20),
        "splits": lambda: Q.split_leaks(rows, key="k", label="y", columns=["p"], drift=0.001, decimals=1),
        "reconstruction": lambda: Q.open_paths(crm, F.col("o_orderstatus") == "F"),
        "banned_column": lambda: Q.banned_columns({"customer": customer}, {"customer": ["c_acctbal", "c_secret"]}),
    })


FLAT = "SELECT CASE WHEN o_orderkey % 9 > 0 THEN o_orderpriority END AS priority, CASE WHEN o_orderkey % 20 > 0 THEN o_totalprice END AS value, o_custkey % 50 AS grp, CASE WHEN o_custkey % 50 = 7 THEN 0 ELSE " + _Y + " END AS y, o_orderkey FROM orders"


@query(f"""WITH f AS ({FLAT})
SELECT 'columns' AS "check", false AS passed, 2.0::DOUBLE AS found
UNION ALL SELECT 'label_complete', true, 0.0 UNION ALL SELECT 'label_binary', true, 0.0 UNION ALL SELECT 'label_both_classes', count(DISTINCT y) = 2, count(DISTINCT y) FROM f
UNION ALL SELECT 'rate', avg(y) BETWEEN 0.15 AND 0.40, round(avg(y), 6) FROM f UNION ALL SELECT 'values', count(*) FILTER (WHERE value < 1000 OR value > 400000) = 0, count(*) FILTER (WHERE value < 1000 OR value > 400000) FROM f
UNION ALL SELECT 'repeated_rows', true, 0.0 UNION ALL SELECT 'missing_cells', false, 1.0
UNION ALL SELECT 'group_grp', count(*) = 0, count(*) FROM (SELECT grp FROM f GROUP BY grp HAVING count(*) >= 20 AND avg(y) IN (0, 1))""")
def flat_checks(spark: SparkSession, d: str) -> DataFrame:
    """A flat dataset with a column too many and one too few, cells missing in one column and a group with one label."""
    o = read_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus"])
    group = F.col("o_custkey") % 50
    flat = o.select(F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_orderkey") % 20 > 0, F.col("o_totalprice")).alias("value"), group.alias("grp"), F.when(group == 7, 0).otherwise((F.col("o_orderstatus") == "F").cast("int")).alias("y"), "o_orderkey")
    out = Q.flat_checks(flat, columns=["priority", "value", "grp", "y", "source"], label="y", value="value", groups=["grp"], values=(1000.0, 400000.0))
    return out.withColumn("found", F.round("found", 6))


@query(f"SELECT {_Y} AS y, count(*) AS n, round(avg(o_totalprice), 4) AS mean_o_totalprice, round(quantile_cont(o_totalprice, 0.5), 4) AS median_o_totalprice FROM orders GROUP BY 1")
def label_profile(spark: SparkSession, d: str) -> DataFrame:
    """Means and medians of the price by label."""
    rows = read_table(spark, d, "orders", ["o_totalprice", "o_orderstatus"]).withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return A.label_profile(rows, "y", ["o_totalprice"]).withColumns({c: F.round(c, 4) for c in ("mean_o_totalprice", "median_o_totalprice")})


@query("SELECT unnest(['a,b', 'c', 'd,e']) AS columns")
def identical_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns that are the same under other names."""
    rows = read_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    rows = rows.select("o_orderkey", F.col("o_custkey").alias("a"), (F.col("o_custkey") + 0).alias("b"), (F.col("o_custkey") + 1).alias("c"), F.col("o_totalprice").alias("d"), F.col("o_totalprice").alias("e"))
    return A.identical_columns(rows, ["a", "b", "c", "d", "e"]).select("columns")


_AUC = "SELECT sum(neg * (cp - pos / 2)) / (max(ap) * max(an)) AS auc FROM (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM (SELECT p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM {rows} GROUP BY p))"


@query(_SPLIT + f", t AS (SELECT *, {_Y} AS y FROM s), g AS (SELECT o_orderpriority, avg(y) AS p FROM t WHERE split = 'train' GROUP BY 1), e AS (SELECT p, y, split FROM t JOIN g USING (o_orderpriority)), a AS (SELECT p, y FROM e WHERE split = 'train'), b AS (SELECT p, y FROM e WHERE split <> 'train') SELECT round((" + _AUC.format(rows="a") + "), 6) AS in_sample, round((" + _AUC.format(rows="b") + "), 6) AS out_of_sample")
def channel_auc(spark: SparkSession, d: str) -> DataFrame:
    """How well a priority's rate among training orders orders them and the others."""
    rows = split_orders(spark, d, "o_orderstatus", "o_orderpriority").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    out = Q.train_rate_auc(rows, "o_orderpriority", "y", F.col("split") == "train")
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(f"SELECT c_custkey, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (c_nationkey % 10) / 10.0::DOUBLE + CASE c_mktsegment WHEN 'BUILDING' THEN 0.25 WHEN 'MACHINERY' THEN -0.25 ELSE 0 END)) AS boosted, c_acctbal > 0 AND {u_sql('seen', 'c_custkey')} < 0.8 AS noisy_flag, CASE WHEN {u_sql('kept', 'c_custkey')} < 0.7 THEN c_mktsegment ELSE (['A', 'B', 'C'])[CAST(floor({u_sql('other', 'c_custkey')} * 3) AS BIGINT) + 1] END AS noisy_segment, CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal < 5000 THEN 'middle' ELSE 'high' END AS compressed FROM customer")
def observers(spark: SparkSession, d: str) -> DataFrame:
    """Latent traits moved by a category, and what is seen of them: a proxy that misses some, a category that is wrong at times, bands instead of values."""
    c = read_table(spark, d, "customer", ["c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"])
    return c.select(
        "c_custkey",
        M.boosted((F.col("c_nationkey") % 10) / 10, F.col("c_mktsegment"), {"BUILDING": 0.25, "MACHINERY": -0.25}).alias("boosted"),
        M.noisy_proxy(F.col("c_acctbal") > 0, 0.8, uniform(SEED, "seen", F.col("c_custkey"))).alias("noisy_flag"),
        M.noisy_category(F.col("c_mktsegment"), ("A", "B", "C"), 0.7, uniform(SEED, "kept", F.col("c_custkey")), uniform(SEED, "other", F.col("c_custkey"))).alias("noisy_segment"),
        M.compressed(F.col("c_acctbal"), [(0, "low"), (5000, "middle")], "high").alias("compressed"),
    )


_GAP = f"{u_sql('missing:o_totalprice', 'o_orderkey')}"


@query(f"SELECT o_orderkey, CASE WHEN {_GAP} >= CASE o_orderpriority WHEN '1-URGENT' THEN 0.15 WHEN '2-HIGH' THEN 0.02 WHEN '3-MEDIUM' THEN 0.05 ELSE 0 END THEN o_totalprice END AS o_totalprice, CASE WHEN {u_sql('missing:o_orderstatus', 'o_orderkey')} >= CASE o_orderpriority WHEN '3-MEDIUM' THEN 0.08 ELSE 0.01 END THEN o_orderstatus END AS o_orderstatus FROM orders")
def missingness_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Several columns with gaps of their own rates by source."""
    rows = read_table(spark, d, "orders", ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"])
    gaps = {"o_totalprice": ({"1-URGENT": 0.15, "2-HIGH": 0.02, "3-MEDIUM": 0.05}, 0.0), "o_orderstatus": ({"3-MEDIUM": 0.08}, 0.01)}
    return M.with_gaps(rows, "o_orderkey", gaps, "o_orderpriority", seed=SEED).drop("o_orderpriority")
