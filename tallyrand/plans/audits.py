"""Audit and sampling queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.random import uniform
from ..operators import audit as A
from ..operators import pointintime as P
from ..operators import sampling as M
from ..sources.tables import materialised, read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
SEED = 7


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def u_sql(stream: str, key: str, index: str = "0", seed: int = SEED) -> str:
    return f"(('0x' || substr(md5({seed} || ':{stream}:' || {key} || ':{index}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_ANCHORED = "WITH a AS (SELECT user_id, CAST(min(ts) AS DATE) AS anchor FROM events GROUP BY user_id), e AS (SELECT e.*, CAST(ts AS DATE) - anchor AS day FROM events e JOIN a USING (user_id))"


@query("""
WITH p AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'), c AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0),
x AS (SELECT 'lineitem' AS child, 'orders' AS parent, l_orderkey AS orphan, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM p) GROUP BY 3
 UNION ALL SELECT 'orders', 'customer', o_custkey, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM c) GROUP BY 3)
SELECT child, parent, count(*) AS n_orphans, CAST(sum(n) AS BIGINT) AS n_rows, string_agg(CAST(orphan AS VARCHAR), ',' ORDER BY orphan) FILTER (WHERE rn <= 5) AS smallest
FROM (SELECT *, row_number() OVER (PARTITION BY child ORDER BY orphan) AS rn FROM x) GROUP BY child, parent""")
def fk_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Parents are filtered on purpose, so that there are orphans."""
    orders, customer = read_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"]), read_table(spark, d, "customer", ["c_custkey", "c_acctbal"])
    lines = read_table(spark, d, "lineitem", ["l_orderkey"])
    return A.orphan_report([("lineitem", lines, "l_orderkey", "orders", orders.where("o_orderstatus <> 'P'"), "o_orderkey"), ("orders", orders, "o_custkey", "customer", customer.where("c_acctbal > 0"), "c_custkey")])


@query("""
WITH op AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00'), cu AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45),
su AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'), f AS (SELECT c_custkey AS lead_id, c_custkey IN (SELECT o_custkey FROM op) AS path_opportunity, c_custkey IN (SELECT o_custkey FROM op WHERE o_orderstatus = 'F') AS path_won,
 c_custkey IN (SELECT o_custkey FROM op WHERE o_orderkey IN (SELECT l_orderkey FROM cu)) AS path_customer, c_custkey IN (SELECT o_custkey FROM op WHERE o_orderkey IN (SELECT l_orderkey FROM cu) AND o_orderkey IN (SELECT l_orderkey FROM su)) AS path_subscription FROM customer)
SELECT *, path_won OR path_customer OR path_subscription AS any_path FROM f""")
def chain_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    """Orders are opportunities; orders with large lines are customers, those with returned lines have subscriptions."""
    orders = P.until(read_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"]), "o_orderdate", "1995-12-31 23:59:59")
    opportunities = orders.select(F.col("o_orderkey").alias("opportunity_id"), F.col("o_custkey").alias("lead_id"), "o_orderstatus")
    lines = read_table(spark, d, "lineitem", ["l_orderkey", "l_quantity", "l_returnflag"])
    customers = lines.where("l_quantity > 45").select(F.col("l_orderkey").alias("customer_id"), F.col("l_orderkey").alias("opportunity_id")).distinct()
    subscriptions = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("customer_id")).distinct()
    leads = read_table(spark, d, "customer", ["c_custkey"]).withColumnRenamed("c_custkey", "lead_id")
    return A.reconstructed(leads, opportunities, customers, subscriptions, won=F.col("o_orderstatus") == "F")


@query(_ANCHORED + " SELECT event_type, count(*) AS n_rows, count(*) FILTER (WHERE day > 10) AS n_violations, count(DISTINCT CASE WHEN day > 10 THEN user_id END) AS n_entities FROM e GROUP BY event_type")
def window_violations(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events", ["user_id", "ts", "event_type"])
    late = F.col("day") > 10
    rows = P.with_day(events, P.first_days(events, "user_id", "ts"), "user_id", "ts")
    return rows.groupBy("event_type").agg(F.count("*").alias("n_rows"), F.count_if(late).alias("n_violations"), F.count_distinct(F.when(late, F.col("user_id"))).alias("n_entities"))


@query("""
WITH t AS (SELECT o_custkey, sum(o_totalprice) AS v, count(*) AS n FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01 00:00:00' GROUP BY 1), w AS (SELECT o_custkey, sum(o_totalprice) AS v, count(*) AS n FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-05 00:00:00' GROUP BY 1)
SELECT 'n' AS "column", count(*) FILTER (WHERE t.n IS DISTINCT FROM w.n) AS n_differing FROM t JOIN w USING (o_custkey) UNION ALL SELECT 'v', count(*) FILTER (WHERE round(t.v, 2) IS DISTINCT FROM round(w.v, 2)) FROM t JOIN w USING (o_custkey)""")
def open_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Features recomputed with the wrong cutoff differ from those that were published."""
    orders = read_table(spark, d, "orders", ["o_custkey", "o_totalprice", "o_orderdate"])
    made = [P.until(orders, "o_orderdate", cut).groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("v"), F.count("*").alias("n")) for cut in ("1998-01-01", "1998-01-05")]
    return A.differing(made[0], made[1], "o_custkey", ["n", "v"])


_SPLIT = f"WITH r AS (SELECT *, row_number() OVER (ORDER BY {u_sql('split', 'o_orderkey')}, o_orderkey) AS rn, count(*) OVER () AS n FROM orders), s AS (SELECT *, CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.7) + floor(n * 0.15) THEN 'valid' ELSE 'test' END AS split FROM r)"


def split_orders(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return M.exact_splits(read_table(spark, d, "orders", ["o_orderkey", *columns]), "o_orderkey", seed=SEED)


@query(_SPLIT + " SELECT o_orderkey, split FROM s")
def split_assign(spark: SparkSession, d: str) -> DataFrame:
    return split_orders(spark, d)


@query(f"SELECT o_orderkey, CASE WHEN {u_sql('split', 'o_orderkey')} < 0.7 THEN 'train' WHEN {u_sql('split', 'o_orderkey')} < 0.85 THEN 'valid' ELSE 'test' END AS split FROM orders")
def split_hashed(spark: SparkSession, d: str) -> DataFrame:
    return M.hashed_splits(read_table(spark, d, "orders", ["o_orderkey"]), "o_orderkey", seed=SEED)


@query(_SPLIT + " SELECT a.split AS left, b.split AS right, count(DISTINCT a.o_custkey) AS n_shared FROM (SELECT DISTINCT o_custkey, split FROM s) a JOIN (SELECT DISTINCT o_custkey, split FROM s) b ON a.o_custkey = b.o_custkey AND a.split < b.split GROUP BY 1, 2".replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"'))
def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose orders are in several splits."""
    return A.split_overlap(split_orders(spark, d, "o_custkey"), "o_custkey")


@query(_SPLIT + ", r2 AS (SELECT split, avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS rate FROM s GROUP BY split) SELECT a.split AS \"left\", b.split AS \"right\", round(abs(a.rate - b.rate), 6) AS drift FROM r2 a JOIN r2 b ON a.split < b.split")
def split_label_drift(spark: SparkSession, d: str) -> DataFrame:
    rows = split_orders(spark, d, "o_orderstatus").withColumn("y", F.col("o_orderstatus") == "F")
    return A.label_drift(rows, "y").withColumn("drift", F.round("drift", 6))


@query(_SPLIT + ", g AS (SELECT DISTINCT split, round_even(o_totalprice / 50000, 1) AS p, CASE WHEN o_orderkey % 3 > 0 THEN round_even(o_custkey, 1) END AS c FROM s) SELECT a.split AS \"left\", b.split AS \"right\", count(*) AS n_shared FROM g a JOIN g b ON a.split < b.split AND a.p = b.p AND a.c IS NOT DISTINCT FROM b.c GROUP BY 1, 2")
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Orders alike in price and customer, rounded, that stand in several splits; a status is no number, and a third of the customers are missing."""
    rows = split_orders(spark, d, "o_totalprice", "o_orderstatus", "o_custkey")
    rows = rows.withColumns({"price": F.col("o_totalprice") / 50000, "customer": F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey"))})
    return A.near_duplicate_rows(rows, ["price", "o_orderstatus", "customer"], 1)


_U = u_sql("subsample", "o_orderkey")


@query(f"(SELECT o_orderkey, 1 AS y FROM orders WHERE o_orderstatus = 'F' ORDER BY {_U}, o_orderkey LIMIT 60) UNION ALL (SELECT o_orderkey, 0 FROM orders WHERE o_orderstatus <> 'F' ORDER BY {_U}, o_orderkey LIMIT 140)")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "orders", ["o_orderkey", "o_orderstatus"]).select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return M.stratified(rows, "o_orderkey", "y", 200, 0.3, seed=SEED)


@query(f"SELECT o_orderkey, CASE WHEN {u_sql('missing:o_totalprice', 'o_orderkey')} >= CASE o_orderpriority WHEN '1-URGENT' THEN 0.3 WHEN '5-LOW' THEN 0.05 ELSE 0.1 END THEN o_totalprice END AS o_totalprice FROM orders")
def missingness_mar(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "orders", ["o_orderkey", "o_totalprice", "o_orderpriority"])
    return M.missing_at_random(rows, "o_orderkey", "o_totalprice", {"1-URGENT": 0.3, "5-LOW": 0.05}, "o_orderpriority", 0.1, seed=SEED).drop("o_orderpriority")


@query(f"SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN round_even(400000 - 5000 * {u_sql('softcap', 'o_orderkey')}, 0) WHEN o_totalprice < 50000 THEN 50000 ELSE o_totalprice END AS capped FROM orders")
def softcap(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "orders", ["o_orderkey", "o_totalprice"])
    return rows.select("o_orderkey", M.soft_cap(F.col("o_totalprice"), 50000.0, 400000.0, 5000.0, uniform(SEED, "softcap", F.col("o_orderkey"))).alias("capped"))


@query("SELECT o_orderkey, greatest(50000.0::DOUBLE, least(400000.0::DOUBLE, o_totalprice)) AS clipped FROM orders")
def hard_clip(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders", ["o_orderkey", "o_totalprice"]).select("o_orderkey", S.clipped(F.col("o_totalprice"), 50000.0, 400000.0).alias("clipped"))


@query("SELECT count(*) AS n_rows, CAST(sum(user_id) AS DOUBLE) AS key_sum, true AS has_missing, true AS moved, true AS not_negative FROM events")
def distort_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What distortion must leave as it is, and that it does something."""
    events = read_table(spark, d, "events", ["event_id", "user_id", "value"])
    out = M.distorted(events, "event_id", ["value"], noise=0.3, missing=0.1, outliers=0.02, seed=SEED, non_negative=["value"])
    both = out.join(events.select("event_id", F.col("value").alias("was")), "event_id")
    low = F.count_if((F.col("value") < 0) & (F.abs("value") < 1e-9)) == 0
    return both.agg(F.count("*").alias("n_rows"), F.sum("user_id").cast("double").alias("key_sum"), (F.count_if(F.col("value").isNull()) > 0).alias("has_missing"), (F.count_if(F.col("value") != F.col("was")) > 0).alias("moved"), low.alias("not_negative"))


@query(_SPLIT + ", t AS (SELECT * FROM s WHERE split = 'train'), g AS (SELECT o_orderpriority, avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS m FROM t WHERE o_orderpriority <> '5-LOW' GROUP BY 1) SELECT o_orderkey, round(coalesce(m, (SELECT avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) FROM t WHERE o_orderpriority <> '5-LOW')), 6) AS encoded FROM s LEFT JOIN g USING (o_orderpriority)")
def target_encoding(spark: SparkSession, d: str) -> DataFrame:
    """Low priorities are kept from training, so they take the overall rate."""
    rows = split_orders(spark, d, "o_orderstatus", "o_orderpriority")
    out = A.target_encoding(rows, (F.col("split") == "train") & (F.col("o_orderpriority") != "5-LOW"), "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int"))
    return out.select("o_orderkey", F.round("encoded", 6).alias("encoded"))


_RATES = "WITH o AS (SELECT *, CASE WHEN o_totalprice > 20000 THEN o_orderpriority END AS channel FROM orders), g AS (SELECT channel, count(*) AS n, count(*) / (SELECT count(*) FROM o) AS share, avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS rate FROM o GROUP BY channel)"


def _channels(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "orders", ["o_totalprice", "o_orderpriority", "o_orderstatus"])
    return rows.select(F.when(F.col("o_totalprice") > 20000, F.col("o_orderpriority")).alias("channel"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))


@query(_RATES + " SELECT channel, n, round(share, 6) AS share, round(rate, 6) AS rate FROM g")
def channel_audit(spark: SparkSession, d: str) -> DataFrame:
    out = A.group_rates(_channels(spark, d), "channel", F.col("y"))
    return out.withColumns({"share": F.round("share", 6), "rate": F.round("rate", 6)})


@query(_RATES + " SELECT count(*) AS n_groups, round(min(rate), 6) AS lowest, round(max(rate), 6) AS highest, round(max(rate) - min(rate), 6) AS spread FROM g WHERE n >= 30")
def category_spread(spark: SparkSession, d: str) -> DataFrame:
    out = A.spread(A.group_rates(_channels(spark, d), "channel", F.col("y"), 30))
    return out.withColumns({c: F.round(c, 6) for c in ("lowest", "highest", "spread")})


@query("SELECT o_custkey, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 6) AS rate FROM orders GROUP BY o_custkey HAVING count(*) >= 10 AND avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) IN (0, 1)")
def group_determinism(spark: SparkSession, d: str) -> DataFrame:
    """Groups of ten or more whose label never varies."""
    rows = read_table(spark, d, "orders", ["o_custkey", "o_orderstatus"])
    per = rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("rate"))
    return per.where((F.col("n") >= 10) & F.col("rate").isin(0.0, 1.0)).withColumn("rate", F.round("rate", 6))


@query("WITH j AS (SELECT c_custkey, event_id, value FROM customer LEFT JOIN events ON user_id = c_custkey) SELECT 'event_id' AS \"column\", round(avg(CASE WHEN event_id IS NULL THEN 1 ELSE 0 END), 6) AS null_rate FROM j UNION ALL SELECT 'value', round(avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END), 6) FROM j UNION ALL SELECT 'c_custkey', 0 FROM j LIMIT 3".replace(" FROM j LIMIT 3", ""))
def null_rates(spark: SparkSession, d: str) -> DataFrame:
    joined = read_table(spark, d, "customer", ["c_custkey"]).join(read_table(spark, d, "events", ["event_id", "user_id", "value"]), F.col("user_id") == F.col("c_custkey"), "left")
    return A.null_rates(joined, ["event_id", "value", "c_custkey"]).withColumn("null_rate", F.round("null_rate", 6))


@query("SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n) - count(*) AS BIGINT) AS n_repeats FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def duplicate_rows(spark: SparkSession, d: str) -> DataFrame:
    return A.repeated_rows(read_table(spark, d, "lineitem", ["l_orderkey", "l_linenumber"]))


@query("SELECT min(l_quantity) AS min, round(avg(l_quantity), 6) AS mean, quantile_cont(l_quantity, 0.5) AS median, round(quantile_cont(l_quantity, 0.95), 6) AS p95, round(quantile_cont(l_quantity, 0.99), 6) AS p99, max(l_quantity) AS max, round((SELECT avg(CASE WHEN l_quantity = (SELECT max(l_quantity) FROM lineitem) THEN 1 ELSE 0 END) FROM lineitem), 6) AS share_at_max FROM lineitem")
def value_stats(spark: SparkSession, d: str) -> DataFrame:
    out = A.value_stats(read_table(spark, d, "lineitem", ["l_quantity"]), "l_quantity")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "p95", "p99", "share_at_max")})


@query(_SPLIT + " SELECT c_custkey, round(count(l_orderkey) / count(DISTINCT o_orderkey), 6) AS lines_per_order FROM s JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE split = 'train' GROUP BY c_custkey")
def parent_density(spark: SparkSession, d: str) -> DataFrame:
    """Lines per order and customer, over training orders only."""
    train = split_orders(spark, d, "o_custkey").where("split = 'train'")
    rows = read_table(spark, d, "lineitem", ["l_orderkey"]).join(train, F.col("l_orderkey") == F.col("o_orderkey")).join(read_table(spark, d, "customer", ["c_custkey"]), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_custkey").agg(F.round(F.count("*") / F.count_distinct("o_orderkey"), 6).alias("lines_per_order"))


@query(_SPLIT + " SELECT o_orderkey, o_totalprice, split FROM s WHERE split = 'train' UNION ALL SELECT o_orderkey, o_totalprice, split FROM s WHERE split = 'valid' UNION ALL SELECT o_orderkey, o_totalprice, split FROM s WHERE split = 'test'")
def flat_union(spark: SparkSession, d: str) -> DataFrame:
    """The splits, one under the other, each with its name."""
    rows = materialised(split_orders(spark, d, "o_totalprice"))  # ranked once for the three parts
    parts = [rows.where(F.col("split") == s).drop("split").withColumn("split", F.lit(s)) for s in ("train", "valid", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SEEDS = f"WITH s AS (SELECT CAST(floor({u_sql('run', 'o_orderkey')} * 5) AS INTEGER) AS run, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders), r AS (SELECT run, avg(y) AS rate FROM s GROUP BY run)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "orders", ["o_orderkey", "o_orderstatus"])
    run = F.floor(uniform(SEED, "run", F.col("o_orderkey")) * 5).cast("int")
    return rows.groupBy(run.alias("run")).agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("rate"))


@query(_SEEDS + " SELECT count(*) AS n_runs, round(quantile_cont(rate, 0.5), 6) AS median, round(max(rate) - min(rate), 6) AS spread, max(rate) / min(rate) <= 5 AND min(rate) > 0 AND max(rate) < 1 AS stable FROM r")
def seed_stability(spark: SparkSession, d: str) -> DataFrame:
    """Fifths of the orders stand for runs with different seeds."""
    stable = (F.try_divide(F.max("rate"), F.min("rate")) <= 5) & (F.min("rate") > 0) & (F.max("rate") < 1)
    return _runs(spark, d).agg(F.count("*").alias("n_runs"), F.round(F.percentile("rate", 0.5), 6).alias("median"), F.round(F.max("rate") - F.min("rate"), 6).alias("spread"), stable.alias("stable"))


BANDS = (("1-URGENT", "rate", 0.30, 0.60), ("2-HIGH", "rate", 0.49, None), ("3-MEDIUM", "rate", None, 0.2), ("9-NONE", "rate", 0.0, 1.0), ("5-LOW", "price", 100000.0, 200000.0))


@query("WITH g AS (SELECT o_orderpriority AS tier, avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS rate, avg(o_totalprice) AS price FROM orders GROUP BY 1), m AS (SELECT tier, 'rate' AS metric, round(rate, 6) AS value FROM g UNION ALL SELECT tier, 'price', round(price, 6) FROM g), b(tier, metric, low, high) AS (VALUES " + ", ".join(f"('{t}', '{m}', {'NULL' if lo is None else lo}::DOUBLE, {'NULL' if hi is None else hi}::DOUBLE)" for t, m, lo, hi in BANDS) + ") SELECT tier, metric, value, low, high FROM b LEFT JOIN m USING (tier, metric) WHERE value IS NULL OR coalesce(value < low, false) OR coalesce(value > high, false)")
def acceptance_gates(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "orders", ["o_orderpriority", "o_orderstatus", "o_totalprice"])
    wide = rows.groupBy(F.col("o_orderpriority").alias("tier")).agg(F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("rate"), F.round(F.avg("o_totalprice"), 6).alias("price"))
    bands = spark.createDataFrame(list(BANDS), "tier string, metric string, low double, high double")
    return A.gate_failures(wide.unpivot(["tier"], ["rate", "price"], "metric", "value"), bands)


@query("SELECT o_orderpriority AS tier, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 6) AS rate, coalesce(round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 6) < lag(round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 6)) OVER (ORDER BY o_orderpriority), true) AS falls FROM orders GROUP BY 1")
def difficulty_ordering(spark: SparkSession, d: str) -> DataFrame:
    """Whether each tier's rate is below that of the tier before; the window is over one row per tier."""
    from pyspark.sql import Window

    rates = read_table(spark, d, "orders", ["o_orderpriority", "o_orderstatus"]).groupBy(F.col("o_orderpriority").alias("tier")).agg(F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("rate"))
    return rates.withColumn("falls", F.coalesce(F.col("rate") < F.lag("rate").over(Window.orderBy("tier")), F.lit(True)))


@query("SELECT count(*) AS n_rows, min(c_acctbal) >= -1000 AS not_too_low, count(DISTINCT c_mktsegment) >= 2 AS varied, avg(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) BETWEEN 0.01 AND 0.95 AS plausible FROM customer")
def realism(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer", ["c_acctbal", "c_mktsegment"])
    return c.agg(F.count("*").alias("n_rows"), (F.min("c_acctbal") >= -1000).alias("not_too_low"), (F.count_distinct("c_mktsegment") >= 2).alias("varied"), F.avg((F.col("c_acctbal") > 0).cast("int")).between(0.01, 0.95).alias("plausible"))
