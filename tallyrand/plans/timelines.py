"""Queries over several dates to an entity: panels, state timelines, rechecks and audits of all channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import fused
from ..operators import timelines as T
from ..sources.tables import read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
FIRST, LAST = "1995-06-01", "2000-12-01"
#: Customers to a task, each of which has 67 months.
CUSTOMERS = 15_000


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _days(column: str):
    return F.datediff(F.to_date(column), F.lit("1970-01-01"))


def _months(spark: SparkSession, d: str) -> DataFrame:
    """(c_custkey, cutoff): every customer at the beginning of every month. Customers are dealt first: their file is small, and one task would make all months of all."""
    months = F.sequence(F.lit(FIRST).cast("date"), F.lit(LAST).cast("date"), F.expr("interval 1 month"))
    customers = read_table(spark, d, "customer", ["c_custkey"])
    tasks = -(-customers.count() // CUSTOMERS) or 1  # from the footers
    return customers.repartition(tasks, "c_custkey").select("c_custkey", F.explode(months).alias("date")).select("c_custkey", _days("date").alias("cutoff"))


_ASKED = f"m AS (SELECT c_custkey, CAST(u AS DATE) - DATE '1970-01-01' AS cutoff FROM customer, unnest(generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '{LAST}', INTERVAL 1 MONTH)) t(u)), o AS (SELECT o_custkey, o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS day, CAST(o_totalprice AS DECIMAL(18, 2)) AS v FROM orders)"


@query(
    "WITH " + _ASKED + """ SELECT c_custkey, cutoff, coalesce(sum(v) FILTER (WHERE day > cutoff AND day <= cutoff + 90), 0)::DOUBLE AS revenue_90d, coalesce(sum(v) FILTER (WHERE day > cutoff AND day <= cutoff + 365), 0)::DOUBLE AS revenue_365d,
coalesce(sum(v) FILTER (WHERE day > cutoff AND day <= cutoff + 730), 0)::DOUBLE AS revenue_730d, count(*) FILTER (WHERE day > cutoff - 365 AND day <= cutoff) AS n_orders_365d
FROM m LEFT JOIN o ON o_custkey = c_custkey AND day > cutoff - 365 AND day <= cutoff + 730 GROUP BY ALL"""
)
def snapshot_panel(spark: SparkSession, d: str) -> DataFrame:
    """Revenue after, and orders before, the first day of every month, for every customer."""
    orders = read_table(spark, d, "orders", ["o_custkey", "o_orderdate", "o_totalprice"])
    events = orders.select(F.col("o_custkey").alias("c_custkey"), _days("o_orderdate").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"), F.lit(1).alias("one"))
    windows = {f"revenue_{n}d": (0, n, "v") for n in (90, 365, 730)} | {"n_orders_365d": (-365, 0, "one")}
    out = T.panel(events, _months(spark, d), "c_custkey", windows)
    return out.select("c_custkey", "cutoff", *(F.col(f"revenue_{n}d").cast("double").alias(f"revenue_{n}d") for n in (90, 365, 730)), F.col("n_orders_365d").cast("long").alias("n_orders_365d"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    orders = read_table(spark, d, "orders", ["o_custkey", "o_orderdate", "o_orderstatus", "o_orderkey"])
    return orders.select(F.col("o_custkey").alias("c_custkey"), _days("o_orderdate").alias("day"), F.col("o_orderstatus").alias("status"), "o_orderkey")


_ISLANDS = """h AS (SELECT o_custkey, day, arg_max(o_orderstatus, o_orderkey) AS status FROM o GROUP BY ALL),
c AS (SELECT *, lag(status) OVER (PARTITION BY o_custkey ORDER BY day) AS before, row_number() OVER (PARTITION BY o_custkey ORDER BY day) AS k FROM h),
i AS (SELECT o_custkey AS c_custkey, status, day AS valid_from, lead(day) OVER (PARTITION BY o_custkey ORDER BY day) AS valid_to FROM c WHERE k = 1 OR status IS DISTINCT FROM before)"""


@query("WITH " + _ASKED + ", " + _ISLANDS + " SELECT * FROM i")
def state_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's status, that of the last order, as intervals of days."""
    return T.intervals(_changes(spark, d), "c_custkey", "status", "o_orderkey")


@query("WITH " + _ASKED + ", " + _ISLANDS + " SELECT m.c_custkey, cutoff AS day, status, valid_from AS since FROM m LEFT JOIN i ON i.c_custkey = m.c_custkey AND valid_from <= cutoff AND (valid_to IS NULL OR valid_to > cutoff)")
def state_asof(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's status on the first day of every month."""
    timeline = T.intervals(_changes(spark, d), "c_custkey", "status", "o_orderkey")
    return T.state_asof(timeline, _months(spark, d).withColumnRenamed("cutoff", "day"), "c_custkey", "status")


@query("""WITH o AS (SELECT o_custkey AS lead_id, o_orderkey, CAST(o_orderdate AS DATE) AS created, CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) + (o_orderkey % 500)::INT END AS closed, CASE WHEN o_orderkey % 11 > 0 THEN o_totalprice END AS acv FROM orders),
l AS (SELECT lead_id, min(created) AS anchor FROM o GROUP BY 1),
s AS (SELECT lead_id, anchor + 400 AS cutoff, bool_or(created <= anchor + 400 AND closed IS NULL) AS has_open, arg_min(acv, (created, o_orderkey)) FILTER (WHERE created <= anchor + 400 AND closed IS NULL AND acv IS NOT NULL) AS v FROM o JOIN l USING (lead_id) GROUP BY ALL),
e AS (SELECT lead_id, bool_or(created <= cutoff AND (closed IS NULL OR closed > cutoff)) AS has_open, arg_min(acv, (created, o_orderkey)) FILTER (WHERE created <= cutoff AND (closed IS NULL OR closed > cutoff) AND acv IS NOT NULL) AS v FROM o JOIN s USING (lead_id) GROUP BY 1)
SELECT 'has_open_opportunity' AS column, count(*) AS n, count(*) FILTER (WHERE s.has_open <> e.has_open) AS n_mismatched FROM s JOIN e USING (lead_id)
UNION ALL SELECT 'opportunity_estimated_acv', count(*), count(*) FILTER (WHERE s.v IS DISTINCT FROM e.v) FROM s JOIN e USING (lead_id)""")
def open_snapshot_recheck(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot whose builder took what is not closed today for what was open at the cutoff, against its source."""
    from ..operators import pointintime as P

    o = read_table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice"])
    created = F.to_date("o_orderdate")
    closed = F.when(F.col("o_orderstatus") != "O", F.date_add(created, (F.col("o_orderkey") % 500).cast("int")))
    opportunities = o.select(F.col("o_custkey").alias("lead_id"), F.col("o_orderkey").alias("opportunity_id"), created.alias("created_at"), closed.alias("closed_at"), F.when(F.col("o_orderkey") % 11 > 0, F.col("o_totalprice")).alias("estimated_acv"))
    leads = opportunities.groupBy("lead_id").agg(F.min("created_at").alias("lead_created_at"))
    today = F.when(F.col("closed_at").isNotNull(), F.lit("1900-01-01").cast("date"))
    rows = opportunities.join(leads, "lead_id").withColumn("cutoff", F.date_add("lead_created_at", 400))
    found = P.first_open(rows, "lead_id", F.col("created_at"), today, F.col("cutoff"), F.col("estimated_acv"), F.col("opportunity_id"))
    shipped = leads.join(found, "lead_id").select("lead_id", "lead_created_at", F.col("has_open").alias("has_open_opportunity"), F.col("open_value").alias("opportunity_estimated_acv"))
    return T.open_recheck(shipped, opportunities, days=400)


@query("""WITH r AS (SELECT CAST(o_orderkey % 3 AS VARCHAR) AS tier, o_orderkey % 10 < 7 AS t, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, CASE WHEN o_totalprice > 20000 THEN o_orderpriority END AS priority, CAST(month(o_orderdate) AS VARCHAR) AS month, CAST(o_custkey % 50 AS VARCHAR) AS grp FROM orders),
u AS (SELECT tier, t, y, 'priority' AS col, priority AS value FROM r UNION ALL SELECT tier, t, y, 'month', month FROM r UNION ALL SELECT tier, t, y, 'grp', grp FROM r),
v AS (SELECT tier, col, value, avg(y) AS rate FROM u WHERE t GROUP BY ALL), b AS (SELECT tier, col, avg(y) AS rate FROM u WHERE t GROUP BY ALL),
s AS (SELECT u.*, coalesce(v.rate, b.rate) AS score FROM u LEFT JOIN v ON v.tier = u.tier AND v.col = u.col AND v.value IS NOT DISTINCT FROM u.value JOIN b ON b.tier = u.tier AND b.col = u.col),
k AS (SELECT tier, col, t, y, rank() OVER (PARTITION BY tier, col, t ORDER BY score) + (count(*) OVER (PARTITION BY tier, col, t, score) - 1) / 2.0 AS rk FROM s),
a AS (SELECT tier, col, t, count(*) AS n, sum(y) AS p, avg(y) AS rate, (sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0) AS auc FROM k GROUP BY ALL),
g AS (SELECT tier, col, count(*) AS n_values, max(rate) - min(rate) AS spread FROM v GROUP BY ALL)
SELECT g.tier, g.col AS column, n_values, x.n AS n_train, z.n AS n_test, round(x.rate, 6) AS train_rate, round(z.rate, 6) AS test_rate, round(spread, 6) AS spread, round(CASE WHEN n_values < 2 THEN 0.5 ELSE coalesce(x.auc, 0.5) END, 6) AS auc_train, round(CASE WHEN n_values < 2 THEN 0.5 ELSE coalesce(z.auc, 0.5) END, 6) AS auc_test
FROM g JOIN a x ON x.tier = g.tier AND x.col = g.col AND x.t JOIN a z ON z.tier = g.tier AND z.col = g.col AND NOT z.t""")
def channel_audit_all(spark: SparkSession, d: str) -> DataFrame:
    """What each category column tells of the label, in training and on the rest, for three tiers at once."""
    o = read_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice"])
    rows = o.select((F.col("o_orderkey") % 3).cast("string").alias("tier"), (F.col("o_orderkey") % 10 < 7).alias("t"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.when(F.col("o_totalprice") > 20000, F.col("o_orderpriority")).alias("priority"), F.month("o_orderdate").alias("month"), (F.col("o_custkey") % 50).alias("grp"))
    out = A.channel_audits(rows, ["priority", "month", "grp"], "y", F.col("t"), "tier")
    return out.withColumns({c: F.round(c, 6) for c in ("train_rate", "test_rate", "spread", "auc_train", "auc_test")})


@query("""WITH r AS (SELECT CAST(o_orderkey % 3 AS VARCHAR) AS tier, CASE WHEN o_totalprice > 20000 THEN o_orderpriority END AS priority, o_totalprice, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders),
a AS (SELECT tier, avg(CASE WHEN priority IS NULL THEN 1.0 ELSE 0.0 END) AS nulls, count(*) FILTER (WHERE o_totalprice < 1000 OR o_totalprice > 400000) AS far, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS odd, avg(y) AS rate, avg(o_totalprice) AS mean FROM r GROUP BY 1)
SELECT tier, 'null_share:priority' AS check, round(nulls, 6)::DOUBLE AS value, nulls <= 0.05 AS ok FROM a UNION ALL SELECT tier, 'violations:o_totalprice_range', far, far = 0 FROM a UNION ALL SELECT tier, 'violations:o_orderstatus_values', odd, odd = 0 FROM a
UNION ALL SELECT tier, 'rate:y', round(rate, 6), rate >= 0.3 AND rate <= 0.4 FROM a UNION ALL SELECT tier, 'mean_price', round(mean, 2), true FROM a""")
def fused_checks(spark: SparkSession, d: str) -> DataFrame:
    """Realism, difficulty and value checks of three tiers from one scan."""
    o = read_table(spark, d, "orders", ["o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"])
    rows = o.select((F.col("o_orderkey") % 3).cast("string").alias("tier"), F.when(F.col("o_totalprice") > 20000, F.col("o_orderpriority")).alias("priority"), "o_totalprice", "o_orderstatus", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    checks = [fused.null_share("priority", 0.05), fused.within("o_totalprice", 1000, 400_000), fused.known_values("o_orderstatus", ["F", "O"]), fused.rate("y", 0.3, 0.4), fused.Check("mean_price", F.avg("o_totalprice"))]
    return fused.checked(rows, checks, ["tier"]).withColumn("value", F.when(F.col("check") == "mean_price", F.round("value", 2)).otherwise(F.round("value", 6)))
