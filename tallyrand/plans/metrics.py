"""Ranking and calibration queries: orders scored by their price, final orders as positives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking as R
from ..sources.tables import read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
TOP = 500_000.0
KS, PERCENTS = (50, 100, 500, 1_000_000), (0.5, 1, 5, 10, 25, 50)
GAINS = tuple(range(0, 101, 10))
THRESHOLDS = tuple(round(0.02 * i, 2) for i in range(1, 31))


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def orders_by() -> dict:
    """The score, and the expected value."""
    return {"by_score": F.col("p"), "by_value": F.col("p") * F.col("value")}


def scored(spark: SparkSession, d: str) -> DataFrame:
    """(o_orderkey, p, y, value)"""
    orders = read_table(spark, d, "orders", ["o_orderkey", "o_totalprice", "o_orderstatus"])
    return orders.select("o_orderkey", F.least(F.lit(1.0), F.floor(F.col("o_totalprice") / 100) * 100 / TOP).alias("p"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.col("o_totalprice").alias("value"))


def order(spark: SparkSession, d: str) -> DataFrame:
    return R.ranked(scored(spark, d), F.col("p"), ["o_orderkey"], descending=True, total="n")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


_S = f"WITH s AS (SELECT o_orderkey, least(1.0::DOUBLE, floor(o_totalprice / 100) * 100 / {TOP}::DOUBLE) AS p, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, o_totalprice AS value FROM orders), "
_R = _S + "r AS (SELECT *, row_number() OVER (ORDER BY p DESC, o_orderkey) AS rn, count(*) OVER () AS n FROM s), "
_D = _S + "g AS (SELECT p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM s GROUP BY p), c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(neg) OVER (ORDER BY p DESC) AS cn, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM g) "
_K = "greatest(1, CAST(round_even(n * percent / 100, 0) AS BIGINT))"


def _percent_sql(percents, columns: str) -> str:
    values = ", ".join(f"({float(p)}::DOUBLE)" for p in percents)
    return _R + f"q AS (SELECT percent, {_K} AS k, rn, y, value, n FROM r, (VALUES {values}) t(percent)), a AS (SELECT percent, any_value(k) AS k, sum(y) FILTER (WHERE rn <= k) AS hits, sum(y) AS total, any_value(n) AS n, sum(y * value) FILTER (WHERE rn <= k) AS hv, sum(y * value) AS tv FROM q GROUP BY percent) SELECT {columns} FROM a"


@query(_R + f"q AS (SELECT k, rn, y, n FROM r, (VALUES {', '.join(f'({k})' for k in KS)}) t(k)) SELECT k, CASE WHEN k <= any_value(n) THEN round(sum(y) FILTER (WHERE rn <= k) / k, 6) END AS precision, CASE WHEN k <= any_value(n) THEN round(sum(y) FILTER (WHERE rn <= k) / sum(y), 6) END AS recall FROM q GROUP BY k")
def precision_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.at_k(order(spark, d), KS), "precision", "recall")


@query(_percent_sql(PERCENTS, "percent, k, round(hits / k, 6) AS rate, round((hits / k) / (total / n), 6) AS lift"))
def lift_at_pct(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.at_percent(order(spark, d), PERCENTS).select("percent", "k", "rate", "lift"), "rate", "lift")


@query(_percent_sql(GAINS[1:-1], "percent, round(hits / total, 6) AS gain") + " UNION ALL SELECT 0, 0 UNION ALL SELECT 100, 1")
def cumulative_gains(spark: SparkSession, d: str) -> DataFrame:
    """The gains curve; its ends are 0 and 1 by definition."""
    inner = rounded(R.at_percent(order(spark, d), GAINS[1:-1]).select("percent", "gain"), "gain")
    return inner.unionByName(spark.createDataFrame([(0.0, 0.0), (100.0, 1.0)], "percent double, gain double"))


@query(_percent_sql((5, 10, 20), "percent, k, round(hv / tv, 6) AS capture"))
def value_capture(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.at_percent(order(spark, d), (5, 10, 20), value="value").select("percent", "k", "capture"), "capture")


@query(
    _S
    + "r AS (SELECT y, value, row_number() OVER (ORDER BY p DESC, o_orderkey) AS a, row_number() OVER (ORDER BY p * value DESC, o_orderkey) AS b, count(*) OVER () AS n FROM s), q AS (SELECT percent, y * value AS v, a <= k AS ia, b <= k AS ib FROM (SELECT *, greatest(1, CAST(round_even(n * percent / 100, 0) AS BIGINT)) AS k FROM r, (VALUES (5.0::DOUBLE), (10.0), (20.0)) t(percent))) SELECT percent, round(sum(v) FILTER (WHERE ia) / sum(v), 6) AS by_score, round(sum(v) FILTER (WHERE ib) / sum(v), 6) AS by_value, round(100 * (sum(v) FILTER (WHERE ib) - sum(v) FILTER (WHERE ia)) / sum(v) FILTER (WHERE ia), 6) AS uplift FROM q GROUP BY percent"
)
def value_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The value captured by two orders, the score and the expected value, and what the second adds in per cent."""
    rows = scored(spark, d)
    one, two = (R.at_percent(R.ranked(rows, by, ["o_orderkey"], descending=True, total="n"), (5, 10, 20), value="value").select("percent", F.col("capture").alias(name)) for name, by in orders_by().items())
    uplift = F.round(100 * F.try_divide(F.col("by_value") - F.col("by_score"), F.col("by_score")), 6)
    return rounded(one.join(two, "percent").withColumn("uplift", uplift), "by_score", "by_value")


@query(
    _S
    + "r AS (SELECT y * value AS v, row_number() OVER (ORDER BY p DESC, o_orderkey) AS a, row_number() OVER (ORDER BY p * value DESC, o_orderkey) AS b, count(*) OVER () AS n FROM s), "
    + "q AS (SELECT k, sum(v) FILTER (WHERE a * 20 <= k * n) AS x, sum(v) FILTER (WHERE b * 20 <= k * n) AS z, sum(v) AS t FROM r, range(1, 21) g(k) GROUP BY k) SELECT k * 5.0::DOUBLE AS percent, round(x / t, 6) AS capture_by_score, round(z / t, 6) AS capture_by_value FROM q"
)
def capture_curves(spark: SparkSession, d: str) -> DataFrame:
    """The whole curves of both orders, in twenty steps."""
    return rounded(R.capture_curve(scored(spark, d), orders_by(), ["o_orderkey"], points=20), "capture_by_score", "capture_by_value")


@query(_S + f"t AS (SELECT * FROM (VALUES {', '.join(f'({t}::DOUBLE)' for t in THRESHOLDS)}) t(threshold)) SELECT threshold, count(*) FILTER (WHERE p >= threshold) AS n, round(sum(y) FILTER (WHERE p >= threshold) / nullif(count(*) FILTER (WHERE p >= threshold), 0), 6) AS precision, round(coalesce(sum(y) FILTER (WHERE p >= threshold), 0) / sum(y), 6) AS recall FROM s, t GROUP BY threshold")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.thresholds(scored(spark, d), THRESHOLDS), "precision", "recall")


@query(_S + "b AS (SELECT least(9, CAST(floor(p * 10) AS INTEGER)) AS bin, p, y FROM s) SELECT bin, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(y), 6) AS rate, round(abs(avg(p) - avg(y)), 6) AS error FROM b GROUP BY bin")
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.calibration(scored(spark, d), 10), "mean_score", "rate", "error")


@query(_S + "b AS (SELECT abs(avg(p) - avg(y)) AS error FROM s GROUP BY least(9, CAST(floor(p * 10) AS INTEGER))) SELECT round(max(error), 6) AS max_error FROM b")
def calibration_max_error(spark: SparkSession, d: str) -> DataFrame:
    return R.calibration(scored(spark, d), 10).agg(F.round(F.max("error"), 6).alias("max_error"))


@query(_D + "SELECT round(sum(neg * (cp - pos / 2)) / (max(ap) * max(an)), 6) AS auc FROM c")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.roc_auc(scored(spark, d)), "auc")


@query(_D + "SELECT round(sum(pos / ap * (cp / (cp + cn))), 6) AS average_precision FROM c")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.average_precision(scored(spark, d)), "average_precision")


@query(_S + "l AS (SELECT p, y, greatest(1e-15::DOUBLE, least(1 - 1e-15::DOUBLE, p)) AS q FROM s) SELECT round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss FROM l")
def brier_logloss(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.losses(scored(spark, d)), "brier", "log_loss")


@query(_S + "c AS (SELECT count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn FROM s) SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c")
def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.confusion(scored(spark, d), F.col("p") >= 0.5), "accuracy", "precision", "recall", "f1")


@query("SELECT o_orderkey, rn <= CAST(round_even(n * 0.85, 0) AS BIGINT) AS early FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)")
def cohort_split(spark: SparkSession, d: str) -> DataFrame:
    """The earliest 85 % of the orders against the rest."""
    orders = read_table(spark, d, "orders", ["o_orderkey", "o_orderdate"])
    rows = R.ranked(orders, F.unix_micros(F.col("o_orderdate").cast("timestamp")), ["o_orderkey"], total="n")
    return rows.select("o_orderkey", (F.col("rn") <= F.bround(F.col("n") * 0.85).cast("long")).alias("early"))


@query("SELECT o_orderkey, CASE WHEN rn <= n // 3 THEN 'A' WHEN rn <= 2 * (n // 3) THEN 'B' ELSE 'C' END AS wave FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)")
def wave_terciles(spark: SparkSession, d: str) -> DataFrame:
    """Thirds by date; the remainder goes to the last."""
    orders = read_table(spark, d, "orders", ["o_orderkey", "o_orderdate"])
    rows = R.ranked(orders, F.unix_micros(F.col("o_orderdate").cast("timestamp")), ["o_orderkey"], total="n")
    third = F.floor(F.col("n") / 3)
    return rows.select("o_orderkey", F.when(F.col("rn") <= third, "A").when(F.col("rn") <= 2 * third, "B").otherwise("C").alias("wave"))


@query("SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 6) AS rate, rank() OVER (ORDER BY round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 6) DESC NULLS LAST) AS place FROM orders GROUP BY o_orderpriority")
def tier_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Groups by falling rate, missing ones last; the window is over one row per group."""
    from pyspark.sql import Window

    rates = read_table(spark, d, "orders", ["o_orderpriority", "o_orderstatus"]).groupBy("o_orderpriority").agg(F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("rate"))
    return rates.withColumn("place", F.rank().over(Window.orderBy(F.desc_nulls_last("rate"))).cast("long"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders", ["o_orderkey", "o_totalprice"]).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_per_key(spark: SparkSession, d: str) -> DataFrame:
    orders = read_table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_orderdate"])
    return orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
