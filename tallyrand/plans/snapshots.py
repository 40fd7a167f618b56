"""Point-in-time queries over the test tables, with SQL for the same rows.

customer is the spine, events are touches (anchor: each user's first day), orders are opportunities, invoices and subscription events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import pointintime as P
from ..sources.tables import read_table

CUTOFF = "1998-01-01"
KINDS = {"views": F.col, "clicks": F.col}
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _kinds() -> dict:
    return {"views": F.col("event_type") == "view", "clicks": F.col("event_type") == "click"}


def _touches(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events", ["user_id", "ts", "event_type"]).withColumnRenamed("user_id", "c_custkey")


def _as_longs(df: DataFrame, *rest: str) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) for c in df.columns if c not in rest), *rest)


_ANCHORED = "WITH a AS (SELECT user_id, CAST(min(ts) AS DATE) AS anchor FROM events GROUP BY user_id), e AS (SELECT e.user_id, event_type, CAST(ts AS DATE) - anchor AS day, event_id, value, ts FROM events e JOIN a USING (user_id))"
_SNAPSHOT = (
    _ANCHORED
    + """, f AS (SELECT user_id, count(*) FILTER (WHERE {inside}) AS n_events, count(*) FILTER (WHERE {inside} AND event_type = 'view') AS n_views,
 count(*) FILTER (WHERE {inside} AND event_type = 'click') AS n_clicks, count(*) FILTER (WHERE {inside} AND day <= 7) AS first_week, count(*) FILTER (WHERE {inside} AND day > {end} - 7) AS last_week,
 {endagg} - min(day) FILTER (WHERE {inside}) AS days_since_first, {endagg} - max(day) FILTER (WHERE {inside}) AS days_since_last, count(*) AS total_all FROM e GROUP BY user_id)
SELECT c_custkey, coalesce(n_events, 0) AS n_events, coalesce(n_views, 0) AS n_views, coalesce(n_clicks, 0) AS n_clicks, coalesce(first_week, 0) AS first_week, coalesce(last_week, 0) AS last_week,
 coalesce(total_all, 0) AS total_all, days_since_first, days_since_last FROM customer LEFT JOIN f ON user_id = c_custkey"""
)


@query(_SNAPSHOT.format(inside="day <= 10", end="10", endagg="10"))
def snapshot_windowed(spark: SparkSession, d: str) -> DataFrame:
    """Features of every customer ten days after the first event."""
    out = P.windowed_snapshot(read_table(spark, d, "customer", ["c_custkey"]), _touches(spark, d), key="c_custkey", ts="ts", window=10, kinds=_kinds())
    return _as_longs(out)


@query(_SNAPSHOT.format(inside="true", end="20", endagg="20"))
def snapshot_full_horizon(spark: SparkSession, d: str) -> DataFrame:
    """Features over all events, as of the horizon: twenty days after the first event."""
    out = P.windowed_snapshot(read_table(spark, d, "customer", ["c_custkey"]), _touches(spark, d), key="c_custkey", ts="ts", window=None, kinds=_kinds(), horizon=20)
    return _as_longs(out)


def customer_features(spine: DataFrame, orders: DataFrame, cutoff) -> DataFrame:
    """Order history and forward revenue at a cutoff column: spine(c_custkey, cutoff), orders(c_custkey, o_orderdate, ...)."""
    rows = orders.join(spine, "c_custkey").withColumn("day", F.datediff(F.to_date("o_orderdate"), cutoff))
    past = F.col("day") <= 0
    history = rows.groupBy("c_custkey").agg(
        F.count_if(past & (F.col("o_orderstatus") == "F")).alias("n_final"),
        F.count_if(past & (F.col("o_orderstatus") == "O")).alias("n_open"),
        F.max(F.when(past, F.to_date("o_orderdate"))).alias("last_order"),
        F.min(F.when(past, F.to_date("o_orderdate"))).alias("first_order"),
        *(F.sum(F.when((F.col("day") > 0) & (F.col("day") <= s), F.col("o_totalprice")).otherwise(0.0)).alias(f"revenue_{s}d") for s in (90, 365, 730)),
    )
    return spine.join(history, "c_custkey", "left")


_CALENDAR = """SELECT c_custkey, count(*) FILTER (WHERE day <= 0 AND o_orderstatus = 'F') AS n_final, count(*) FILTER (WHERE day <= 0 AND o_orderstatus = 'O') AS n_open,
 {cut} - max(od) FILTER (WHERE day <= 0) AS days_since_order, CAST(floor(({cut} - min(od) FILTER (WHERE day <= 0)) / 7.0) AS BIGINT) AS tenure_weeks,
 {rev} FROM (SELECT c_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS od, CAST(o_orderdate AS DATE) - {cut0} AS day{more} FROM {src}) GROUP BY c_custkey{group} HAVING count(*) FILTER (WHERE day <= 0) > 0"""
_REV = ", ".join(f"round(coalesce(sum(o_totalprice) FILTER (WHERE day > 0 AND day <= {s}), 0), 2) AS revenue_{s}d" for s in (90, 365, 730))


def _calendar(spark: SparkSession, d: str, spine: DataFrame) -> DataFrame:
    orders = read_table(spark, d, "orders", ["o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice"]).withColumnRenamed("o_custkey", "c_custkey")
    out = customer_features(spine, orders, F.col("cutoff")).where(F.col("last_order").isNotNull())  # eligible: started by the cutoff
    return out.select(
        "c_custkey",
        "n_final",
        "n_open",
        F.datediff("cutoff", "last_order").cast("long").alias("days_since_order"),
        S.floor_weeks(F.datediff("cutoff", "first_order")).cast("long").alias("tenure_weeks"),
        *(F.round(f"revenue_{s}d", 2).alias(f"revenue_{s}d") for s in (90, 365, 730)),
    )


@query(_CALENDAR.format(cut=f"DATE '{CUTOFF}'", cut0=f"DATE '{CUTOFF}'", more="", rev=_REV, group="", src="orders JOIN customer ON o_custkey = c_custkey"))
def snapshot_calendar(spark: SparkSession, d: str) -> DataFrame:
    """One cutoff for all customers who had ordered by then."""
    return _calendar(spark, d, read_table(spark, d, "customer", ["c_custkey"]).withColumn("cutoff", F.to_date(F.lit(CUTOFF))))


@query(
    _CALENDAR.format(
        cut="any_value(cutoff)", cut0="cutoff", more=", cutoff", rev=_REV, group="",
        src="(SELECT o.*, c_custkey, s.cutoff FROM orders o JOIN customer ON o_custkey = c_custkey JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) + 28 AS cutoff FROM orders GROUP BY o_custkey) s USING (o_custkey))",
    )
)
def snapshot_tenure(spark: SparkSession, d: str) -> DataFrame:
    """Each customer four weeks after the first order."""
    orders = read_table(spark, d, "orders", ["o_custkey", "o_orderdate"])
    starts = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.date_add(F.to_date(F.min("o_orderdate")), 28).alias("cutoff"))
    return _calendar(spark, d, read_table(spark, d, "customer", ["c_custkey"]).join(starts, "c_custkey"))


@query(_ANCHORED + " SELECT event_id, user_id, event_type FROM e WHERE day <= 10")
def snapshot_safe_relative(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events", ["event_id", "user_id", "event_type", "ts"])
    return P.safe_events(events, P.first_days(events, "user_id", "ts"), key="user_id", ts="ts", window=10).drop("ts")


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderdate <= TIMESTAMP '{CUTOFF} 00:00:00'")
def snapshot_safe_absolute(spark: SparkSession, d: str) -> DataFrame:
    return P.until(read_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"]), "o_orderdate", CUTOFF).drop("o_orderdate")


@query(
    f"SELECT o_custkey, {', '.join(f'round(sum(CASE WHEN o_orderstatus IN ($$F$$, $$O$$) AND day > 0 AND day <= {s} THEN o_totalprice ELSE 0 END), 2) AS revenue_{s}d' for s in (90, 365, 730))} FROM (SELECT *, CAST(o_orderdate AS DATE) - DATE '{CUTOFF}' AS day FROM orders) GROUP BY o_custkey"
)
def forward_revenue(spark: SparkSession, d: str) -> DataFrame:
    orders = read_table(spark, d, "orders", ["o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice"])
    out = P.forward_sums(orders, "o_custkey", F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit(CUTOFF))), F.col("o_totalprice"), F.col("o_orderstatus").isin("F", "O"), (90, 365, 730))
    return out.select("o_custkey", *(F.round(c, 2).alias(c) for c in out.columns[1:]))


@query(
    "SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase, count(*) FILTER (WHERE event_type = 'error') AS n_error, round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0), 4) AS purchase_value, max(CASE WHEN event_type = 'error' THEN CAST(ts AS DATE) END) AS last_error FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY user_id"
)
def event_pivot_agg(spark: SparkSession, d: str) -> DataFrame:
    events = P.until(read_table(spark, d, "events", ["user_id", "event_type", "value", "ts"]), "ts", "2024-01-20 00:00:00")
    is_ = lambda kind: F.col("event_type") == kind
    return events.groupBy("user_id").agg(
        F.count_if(is_("purchase")).alias("n_purchase"), F.count_if(is_("error")).alias("n_error"), F.round(F.sum(F.when(is_("purchase"), F.col("value")).otherwise(0.0)), 4).alias("purchase_value"), F.max(F.when(is_("error"), F.to_date("ts"))).alias("last_error")
    )


@query(
    "WITH e AS (SELECT user_id, value, CAST(ts AS DATE) - DATE '2024-01-25' AS day FROM events) SELECT user_id, round(avg(value) FILTER (WHERE day > -12 AND day <= 0), 6) AS avg_value, round(sum(value) FILTER (WHERE day > -12 AND day <= 0), 4) AS sum_value, count(value) FILTER (WHERE day > -12 AND day <= 0) AS n_values, round(regr_slope(value, day) FILTER (WHERE day > -12 AND day <= 0), 6) AS slope FROM e GROUP BY user_id"
)
def trailing_slope(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events", ["user_id", "value", "ts"])
    day = F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-25")))
    out = P.trailing(events, "user_id", day, 12, {"avg_value": ("avg", F.col("value")), "sum_value": ("sum", F.col("value")), "n_values": ("count", F.col("value")), "slope": ("slope", F.col("value"))})
    return out.select("user_id", F.round("avg_value", 6).alias("avg_value"), F.round("sum_value", 4).alias("sum_value"), "n_values", F.round("slope", 6).alias("slope"))


@query("SELECT user_id, arg_max(value, ts) FILTER (WHERE event_type IN ('view', 'click') AND value > 20) AS last_value FROM events GROUP BY user_id")
def last_non_null(spark: SparkSession, d: str) -> DataFrame:
    """Only views and clicks above 20 have a value here; the others are null."""
    value = F.when(F.col("event_type").isin("view", "click") & (F.col("value") > 20), F.col("value"))
    return P.last_known(read_table(spark, d, "events", ["user_id", "value", "ts", "event_type"]), "user_id", F.col("ts"), value, "last_value")


@query(
    f"WITH o AS (SELECT *, o_orderdate <= TIMESTAMP '{CUTOFF} 00:00:00' AS made, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 400 END AS closed FROM orders), p AS (SELECT *, made AND (closed IS NULL OR closed > DATE '{CUTOFF}') AS open FROM o) SELECT o_custkey, bool_or(made) AS any_created, bool_or(open) AS has_open, arg_min(o_totalprice, (o_orderdate, o_orderkey)) FILTER (WHERE open) AS open_value FROM p GROUP BY o_custkey"
)
def first_open_opportunity(spark: SparkSession, d: str) -> DataFrame:
    """Final orders close 400 days after they were made; the others stay open."""
    orders = read_table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice"])
    made = F.col("o_orderdate")
    closed = F.when(F.col("o_orderstatus") == "F", F.date_add(F.to_date(made), 400)).cast("timestamp")
    return P.first_open(orders, "o_custkey", made, closed, F.to_timestamp(F.lit(CUTOFF)), F.col("o_totalprice"), F.col("o_orderkey"))


MIDPOINTS = {"AUTOMOBILE": 30000.0, "BUILDING": 45000.0, "FURNITURE": 60000.0, "MACHINERY": 90000.0}


@query(
    f"WITH o AS (SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS v FROM orders WHERE o_orderstatus = 'P' AND o_orderdate <= TIMESTAMP '{CUTOFF} 00:00:00' GROUP BY o_custkey) SELECT c_custkey, coalesce(v, CASE c_mktsegment {' '.join(f'WHEN $${k}$$ THEN {v}' for k, v in MIDPOINTS.items())} ELSE 50000.0 END) AS expected_value, n_name FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey"
)
def expected_value_fallback(spark: SparkSession, d: str) -> DataFrame:
    orders = read_table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice"]).where("o_orderstatus = 'P'")
    known = P.until(orders, "o_orderdate", CUTOFF).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("v"))
    nation = read_table(spark, d, "nation", ["n_nationkey", "n_name"])
    out = read_table(spark, d, "customer", ["c_custkey", "c_mktsegment", "c_nationkey"]).join(known, "c_custkey", "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return out.select("c_custkey", F.coalesce("v", S.mapped(F.col("c_mktsegment"), MIDPOINTS, 50000.0)).alias("expected_value"), "n_name")


@query("SELECT c_custkey, CAST(DATE '2024-02-01' - CAST(max(ts) AS DATE) AS BIGINT) AS days_since_event FROM customer JOIN events ON user_id = c_custkey GROUP BY c_custkey")
def event_recency(spark: SparkSession, d: str) -> DataFrame:
    last = read_table(spark, d, "events", ["user_id", "ts"]).groupBy(F.col("user_id").alias("c_custkey")).agg(F.to_date(F.max("ts")).alias("last"))
    return read_table(spark, d, "customer", ["c_custkey"]).join(last, "c_custkey").select("c_custkey", F.datediff(F.to_date(F.lit("2024-02-01")), "last").cast("long").alias("days_since_event"))


@query("SELECT 'events' AS table_name, min(CAST(DATE '2024-02-01' - CAST(ts AS DATE) AS BIGINT)) AS headroom_days FROM events UNION ALL SELECT 'orders', min(CAST(DATE '2001-12-31' - CAST(o_orderdate AS DATE) AS BIGINT)) FROM orders")
def cutoff_headroom(spark: SparkSession, d: str) -> DataFrame:
    def room(name: str, ts: str, cutoff: str) -> DataFrame:
        return read_table(spark, d, name, [ts]).agg(F.min(F.datediff(F.to_date(F.lit(cutoff)), F.to_date(ts))).cast("long").alias("headroom_days")).select(F.lit(name).alias("table_name"), "headroom_days")

    return room("events", "ts", "2024-02-01").unionByName(room("orders", "o_orderdate", "2001-12-31"))


_POST = _ANCHORED + " SELECT c_custkey, count(user_id) AS n_after FROM customer LEFT JOIN e ON user_id = c_custkey AND day > 10 AND day <= 20 GROUP BY c_custkey"


@query(_POST)
def post_snapshot_band(spark: SparkSession, d: str) -> DataFrame:
    """Events in the ten days after the snapshot, 0 for customers without."""
    touches = _touches(spark, d)
    rows = P.with_day(touches, P.first_days(touches, "c_custkey", "ts"), "c_custkey", "ts")
    found = rows.groupBy("c_custkey").agg(F.count_if((F.col("day") > 10) & (F.col("day") <= 20)).alias("n_after"))
    return P.onto_spine(read_table(spark, d, "customer", ["c_custkey"]), found, "c_custkey", ["n_after"])


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY user_id")
def channel_pivot(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events", ["user_id", "event_type"])
    return events.groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).count().na.fill(0)
