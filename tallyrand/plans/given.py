"""Lead snapshots and flat datasets over the test tables: orders stand for leads, customers for accounts, suppliers for contacts and line items for all that happens to a lead."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import day_of
from ..generate.motifs import REVENUE_MIDPOINT
from ..operators import flat, snapshots
from ..sources.tables import read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: What a line item's part tells: the day of what it stands for, counted from its order's.
SPAN = 100
SOURCES = {"1-URGENT": "sdr_outbound", "2-HIGH": "inbound_marketing", "3-MEDIUM": "partner_referral"}
BANDS = tuple(REVENUE_MIDPOINT)


def given_world(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The tables of a lead world, of given rows: each line item is a touch, those sent back are sessions too, open ones activities, and the first three of an order opportunities."""
    text = lambda c: F.col(c).cast("string")
    customer, supplier = read_table(spark, d, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"]), read_table(spark, d, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"])
    orders = read_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority"])
    items = read_table(spark, d, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"])
    accounts = customer.select(
        text("c_custkey").alias("account_id"), F.col("c_mktsegment").alias("industry"), text("c_nationkey").alias("region"), F.when(F.col("c_acctbal") < 0, "200-499").when(F.col("c_acctbal") < 5000, "500-999").otherwise("1000-1999").alias("employee_band"),
        F.element_at(F.array(*map(F.lit, BANDS)), (F.col("c_custkey") % len(BANDS) + 1).cast("int")).alias("estimated_revenue_band"), F.when(F.col("c_custkey") % 3 == 0, "low").otherwise("high").alias("process_maturity_band"), F.lit(None).cast("string").alias("created_at"),
    )
    contacts = supplier.select(text("s_suppkey").alias("contact_id"), F.when(F.col("s_acctbal") < 3000, "finance").otherwise("it").alias("role_function"), F.when(F.col("s_nationkey") < 12, "manager").otherwise("director").alias("seniority"), text("s_nationkey").alias("buyer_role"))
    source = F.lit("event")
    for priority, name in SOURCES.items():
        source = F.when(F.col("o_orderpriority") == priority, name).otherwise(source)
    leads = orders.select(
        text("o_orderkey").alias("lead_id"), text("o_custkey").alias("account_id"), (F.col("o_orderkey") % 10).cast("string").alias("contact_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("lead_created_at"), source.alias("lead_source"), F.col("o_orderstatus").alias("current_stage"),
        (F.col("o_orderstatus") != "P").alias("is_sql"), (F.col("o_orderstatus") == "F").alias("converted_within_90_days"),
    )
    # An order's day is its line items' too; those without an order have none, and no lead. They meet by the lead's id, by which the snapshot joins them again, so they are shuffled once.
    dated = items.withColumn("lead_id", text("l_orderkey")).join(leads.select("lead_id", day_of(F.col("lead_created_at")).alias("made")), "lead_id")
    on = lambda days: F.date_format(F.date_add("made", days), "yyyy-MM-dd")
    day = (F.col("l_partkey") % SPAN).cast("int")
    lead = "lead_id"
    return {
        "accounts": accounts,
        "contacts": contacts,
        "leads": leads,
        "touches": dated.select(lead, on(day).alias("touch_timestamp"), F.when(F.col("l_suppkey") % 2 == 0, "inbound").otherwise("outbound").alias("touch_direction")),
        "sessions": dated.where("l_returnflag = 'R'").select(lead, on(day).alias("session_timestamp"), (F.col("l_suppkey") % 3).alias("pricing_page_views"), (F.col("l_suppkey") % 2).alias("demo_page_views"), F.col("l_quantity").cast("long").alias("session_duration_seconds")),
        "sales_activities": dated.where("l_linestatus = 'O'").select(lead, on(day).alias("activity_timestamp")),
        "opportunities": dated.where("l_linenumber <= 3").select(
            lead, F.concat_ws(":", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_extendedprice").cast("long")).alias("opportunity_id"), on(day).alias("created_at"), F.col("l_extendedprice").cast("long").alias("estimated_acv"), F.when(F.col("l_returnflag") == "A", on(day + F.col("l_quantity").cast("int"))).alias("closed_at")
        ),
    }


#: One date for all customers.
CUTOFF = "1998-06-30"


def given_customers(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The tables of a lifecycle world, of given rows: a customer starts with the first order and, one in five, ends with the last; orders are events and invoices, line items weekly signals. Customers without orders have none."""
    text = lambda c: F.col(c).cast("string")
    orders = read_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice"])
    spans = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    customer = read_table(spark, d, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"]).join(spans, F.col("c_custkey") == F.col("o_custkey"))
    items = read_table(spark, d, "lineitem", ["l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_linenumber", "l_returnflag"]).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    at = F.date_add(day_of(F.col("o_orderdate")), (F.col("l_partkey") % SPAN).cast("int"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    key, status = text("o_custkey").alias("customer_id"), F.col("o_orderstatus")
    return {
        "accounts": given_world(spark, d)["accounts"],
        "customers": customer.select(
            text("c_custkey").alias("customer_id"), text("c_custkey").alias("account_id"), iso("first").alias("customer_start_at"), F.col("c_mktsegment").alias("initial_plan"), (1000 + 10 * F.col("c_nationkey")).cast("long").alias("initial_mrr"),
            F.element_at(F.array(F.lit(3), F.lit(6), F.lit(12)), (F.col("c_custkey") % 3 + 1).cast("int")).alias("contract_term_months"),
        ),
        "subscriptions": customer.select(text("c_custkey").alias("customer_id"), F.when(F.col("c_custkey") % 5 == 0, iso("last")).alias("churn_at")),
        "subscription_events": orders.select(key, iso("o_orderdate").alias("event_timestamp"), F.when(status == "P", "renewal").when(status == "O", "expansion").otherwise("payment_failure").alias("event_type"), F.lit(0).cast("long").alias("mrr_before"), (F.col("o_orderkey") % 500).alias("mrr_after")),
        # A score is that of its day, so that those of one day agree.
        "health_signals": items.select(key, iso(at).alias("period_start"), F.col("l_quantity").cast("long").alias("active_users"), F.col("l_discount").alias("feature_depth_score"), F.col("l_linenumber").cast("long").alias("support_tickets"), F.when(F.col("l_returnflag") != "A", F.dayofmonth(at)).alias("nps_score")),
        "invoices": orders.select(key, iso("o_orderdate").alias("invoice_date"), F.when(status == "F", "paid").when(status == "O", "recovered").otherwise("failed").alias("payment_status"), F.col("o_totalprice").cast("long").alias("amount_usd")),
    }


def _customers_sql(cut: str) -> str:
    """The customer snapshot at an SQL date that may use ``start``."""
    lately = "p AND hday > -84"
    return f"""WITH w AS (SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal, start, CASE WHEN c_custkey % 5 = 0 THEN ended END AS churn, {cut} AS cutoff FROM (SELECT c.*, CAST(min(o_orderdate) AS DATE) AS start, CAST(max(o_orderdate) AS DATE) AS ended FROM customer c JOIN orders ON o_custkey = c_custkey GROUP BY ALL)),
who AS (SELECT *, (cutoff - start) // 7 AS tenure, CASE c_custkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 6 ELSE 12 END AS term FROM w WHERE start <= cutoff AND (churn IS NULL OR churn > cutoff)),
o AS (SELECT c_custkey, CAST(o_orderdate AS DATE) - cutoff AS day, o_orderstatus AS s, o_orderkey % 500 AS up, CAST(trunc(o_totalprice) AS BIGINT) AS usd FROM orders JOIN who ON o_custkey = c_custkey),
op AS (SELECT c_custkey, coalesce(sum(up) FILTER (WHERE s = 'O' AND day <= 0), 0) AS grown, coalesce(sum(up) FILTER (WHERE s = 'O'), 0) AS grown_all, count(*) FILTER (WHERE s = 'P' AND day <= 0) AS renewals, count(*) FILTER (WHERE s = 'O' AND day <= 0) AS expansions, count(*) FILTER (WHERE s = 'F' AND day <= 0) AS failures, max(day) FILTER (WHERE s = 'F' AND day <= 0) AS failed,
{', '.join(f"coalesce(sum(usd) FILTER (WHERE s <> 'P' AND day > 0 AND day <= {n}), 0) AS r{n}" for n in (90, 365, 730))} FROM o GROUP BY c_custkey),
h AS (SELECT c_custkey, seen - cutoff AS hday, seen <= cutoff AS p, CAST(l_quantity AS BIGINT) AS users, l_discount AS depth, l_linenumber AS tickets, CASE WHEN l_returnflag <> 'A' THEN day(seen) END AS nps FROM (SELECT l.*, who.c_custkey, cutoff, CAST(o_orderdate AS DATE) + CAST(l_partkey % {SPAN} AS INTEGER) AS seen FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN who ON o_custkey = c_custkey)),
hp AS (SELECT c_custkey, round(avg(users) FILTER (WHERE {lately}), 6) AS avg_users, CASE WHEN count(DISTINCT hday) FILTER (WHERE {lately}) > 1 THEN round(regr_slope(users::DOUBLE, hday / 7.0::DOUBLE) FILTER (WHERE {lately}), 6) END AS trend, round(avg(depth) FILTER (WHERE {lately}), 6) AS depth, coalesce(sum(tickets) FILTER (WHERE {lately}), 0) AS tickets, arg_max(nps, hday) FILTER (WHERE p AND nps IS NOT NULL) AS nps FROM h GROUP BY c_custkey),
n AS (SELECT c_custkey, min(CASE WHEN round_even(k * term * 13 / 3.0, 0) > tenure THEN round_even(k * term * 13 / 3.0, 0) END) - any_value(tenure) AS left_weeks FROM who, range(0, 200) r(k) GROUP BY c_custkey)
SELECT c_custkey::VARCHAR AS customer_id, c_custkey::VARCHAR AS account_id, c_mktsegment AS industry, c_nationkey::VARCHAR AS region, CASE WHEN c_acctbal < 0 THEN '200-499' WHEN c_acctbal < 5000 THEN '500-999' ELSE '1000-1999' END AS employee_band, ({list(BANDS)})[CAST(c_custkey % {len(BANDS)} + 1 AS BIGINT)] AS estimated_revenue_band, CAST(tenure AS BIGINT) AS tenure_weeks, c_mktsegment AS initial_plan,
CAST(1000 + 10 * c_nationkey AS BIGINT) AS initial_mrr, CAST(1000 + 10 * c_nationkey + grown AS BIGINT) AS current_mrr, CAST(grown AS BIGINT) AS mrr_change_at_snapshot, renewals AS renewal_count, expansions AS expansion_count, CAST(term AS BIGINT) AS contract_term_months, CAST(left_weeks AS BIGINT) AS weeks_to_next_renewal, avg_users AS avg_active_users_l12w, trend AS active_user_trend_l12w, depth AS avg_feature_depth_l12w,
CAST(coalesce(tickets, 0) AS BIGINT) AS support_ticket_count_l12w, CAST(nps AS BIGINT) AS last_nps_score, failures AS payment_failure_count, CAST(floor(-failed / 7.0) AS BIGINT) AS weeks_since_last_payment_failure, CAST(grown_all AS BIGINT) AS mrr_change_full_period, {', '.join(f'r{n}::DOUBLE AS ltv_revenue_{n}d' for n in (90, 365, 730))}, coalesce(churn <= cutoff + 180, false) AS churned_within_180d
FROM who JOIN op USING (c_custkey) LEFT JOIN hp USING (c_custkey) JOIN n USING (c_custkey)"""


def customer_snapshot_at(when: dict, spark: SparkSession, d: str) -> DataFrame:
    """The library's customer snapshot of the given rows."""
    out = snapshots.customer_snapshot(given_customers(spark, d), **when)
    return out.withColumns({c: F.round(c, 6) for c in ("avg_active_users_l12w", "active_user_trend_l12w", "avg_feature_depth_l12w")})


_U = "(('0x' || substr(md5('{seed}:{stream}:' || lead_id || ':0'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _world_sql(day: int) -> str:
    """CTEs up to ``snap``, the lead snapshot of a day."""
    source = "CASE o_orderpriority " + " ".join(f"WHEN '{p}' THEN '{s}'" for p, s in SOURCES.items()) + " ELSE 'event' END"
    middle = "CASE estimated_revenue_band " + " ".join(f"WHEN '{b}' THEN {v}::DOUBLE" for b, v in REVENUE_MIDPOINT.items()) + " END"
    inside = f"day <= {day}"
    opened = f"l_linenumber <= 3 AND {inside}"
    still = f"{opened} AND NOT (l_returnflag = 'A' AND day + CAST(l_quantity AS INTEGER) <= {day})"
    best = "(day, l_partkey || ':' || l_suppkey || ':' || l_linenumber || ':' || CAST(trunc(l_extendedprice) AS BIGINT))"
    return f"""WITH e AS (SELECT lineitem.*, l_partkey % {SPAN} AS day FROM lineitem),
per AS (SELECT l_orderkey, count(*) FILTER (WHERE {inside}) AS touch_count, count(*) FILTER (WHERE {inside} AND l_suppkey % 2 = 0) AS inbound_touch_count, count(*) FILTER (WHERE {inside} AND l_suppkey % 2 = 1) AS outbound_touch_count,
count(*) FILTER (WHERE {inside} AND l_returnflag = 'R') AS session_count, sum(l_suppkey % 3) FILTER (WHERE {inside} AND l_returnflag = 'R') AS pricing_page_views, sum(l_suppkey % 2) FILTER (WHERE {inside} AND l_returnflag = 'R') AS demo_page_views, sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE {inside} AND l_returnflag = 'R') AS duration,
count(*) FILTER (WHERE {inside} AND day <= 7) AS first_week, count(*) FILTER (WHERE {inside} AND day > {day} - 7) AS last_week, {day} - min(day) FILTER (WHERE {inside}) AS since_first, {day} - max(day) FILTER (WHERE {inside}) AS since_last, count(*) FILTER (WHERE {inside} AND l_linestatus = 'O') AS activity_count,
bool_or({opened}) AS created, bool_or({still}) AS is_open, arg_min(CAST(trunc(l_extendedprice) AS BIGINT), {best}) FILTER (WHERE {still}) AS acv, count(*) AS total, count(*) FILTER (WHERE day > {day} AND day <= 90) AS after FROM e GROUP BY l_orderkey),
a AS (SELECT c_custkey, c_mktsegment AS industry, c_nationkey::VARCHAR AS region, CASE WHEN c_acctbal < 0 THEN '200-499' WHEN c_acctbal < 5000 THEN '500-999' ELSE '1000-1999' END AS employee_band, ({list(BANDS)})[CAST(c_custkey % {len(BANDS)} + 1 AS BIGINT)] AS estimated_revenue_band, CASE WHEN c_custkey % 3 = 0 THEN 'low' ELSE 'high' END AS process_maturity_band FROM customer),
snap AS (SELECT o_custkey::VARCHAR AS account_id, industry, region, employee_band, estimated_revenue_band, process_maturity_band, (o_orderkey % 10)::VARCHAR AS contact_id, CASE WHEN s_suppkey IS NULL THEN NULL WHEN s_acctbal < 3000 THEN 'finance' ELSE 'it' END AS role_function, CASE WHEN s_suppkey IS NULL THEN NULL WHEN s_nationkey < 12 THEN 'manager' ELSE 'director' END AS seniority, s_nationkey::VARCHAR AS buyer_role,
o_orderkey::VARCHAR AS lead_id, strftime(o_orderdate, '%Y-%m-%d') AS lead_created_at, {source} AS lead_source, o_orderstatus AS current_stage, o_orderstatus <> 'P' AS is_sql, coalesce(touch_count, 0) AS touch_count, coalesce(inbound_touch_count, 0) AS inbound_touch_count, coalesce(outbound_touch_count, 0) AS outbound_touch_count, coalesce(session_count, 0) AS session_count,
CAST(coalesce(pricing_page_views, 0) AS BIGINT) AS pricing_page_views, CAST(coalesce(demo_page_views, 0) AS BIGINT) AS demo_page_views, CAST(coalesce(duration, 0) AS BIGINT) AS total_session_duration_seconds, coalesce(first_week, 0) AS touches_days_0_7, coalesce(last_week, 0) AS touches_last_7_days, since_first::DOUBLE AS days_since_first_touch, coalesce(activity_count, 0) AS activity_count, since_last::DOUBLE AS days_since_last_touch,
coalesce(created, false) AS opportunity_created, coalesce(is_open, false) AS has_open_opportunity, acv::DOUBLE AS opportunity_estimated_acv, coalesce(acv::DOUBLE, {middle}) AS expected_acv, coalesce(total, 0) AS total_touches_all, o_orderstatus = 'F' AS converted_within_90_days, coalesce(after, 0) AS touches_after
FROM orders LEFT JOIN per ON l_orderkey = o_orderkey LEFT JOIN a ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = o_orderkey % 10)"""


def lead_snapshot_at(day: int, spark: SparkSession, d: str) -> DataFrame:
    """The library's lead snapshot of the given rows."""
    return snapshots.lead_snapshot(given_world(spark, d), window=day)


def flat_version(name: str, instructor: bool, spark: SparkSession, d: str) -> DataFrame:
    world, version = given_world(spark, d), flat.VERSIONS[name]
    return flat.build(snapshots.lead_snapshot(world, window=version.day), version, touches=world["touches"], instructor=instructor)


def _poisson_sql(rate: float, u: str) -> str:
    import math

    p = c = math.exp(-rate)
    cases = []
    for k in range(64):
        cases.append(f"WHEN {u} < {c!r}::DOUBLE THEN {k}")
        p = p * rate / (k + 1)
        c += p
        if c >= 1 - 2**-40:
            break
    return "CASE " + " ".join(cases) + f" ELSE {len(cases)} END"


def _flat_sql(name: str, instructor: bool) -> str:
    v = flat.VERSIONS[name]
    u = lambda stream: _U.format(seed=v.seed, stream=stream)
    floor, cap = v.bounds
    value = {"hard": f"least(greatest(expected_acv, {floor}::DOUBLE), {cap}::DOUBLE)", "soft": f"round_even(CASE WHEN expected_acv > {cap} THEN round_even({cap}::DOUBLE - {v.width}::DOUBLE * {u('softcap')}, 0) WHEN expected_acv < {floor} THEN {floor}::DOUBLE ELSE expected_acv END, 0)", None: "expected_acv"}[v.cap]
    wave = f"CASE WHEN {u('wave-noise')} < 0.05 THEN (['A', 'B', 'C'])[CAST(floor({u('wave')} * 3) AS BIGINT) + 1] WHEN rn <= n // 3 THEN 'A' WHEN rn <= 2 * (n // 3) THEN 'B' ELSE 'C' END"
    leaks = v.trap is not None and (instructor or not v.instructor_only)
    positives = int(v.n * v.rate + 0.5)
    columns = []
    for a, b in flat.NAMES.items():
        if a in (*v.without, "total_touches_all"):
            continue
        if (gap := flat.GAPS[v.gaps].get(b)) is not None:
            rates = "".join(f"WHEN '{s}' THEN {r}::DOUBLE " for s, r in gap[0].items())
            rate = f"CASE lead_source {rates}ELSE {gap[1]}::DOUBLE END" if rates else f"{gap[1]}::DOUBLE"
            columns.append(f"CASE WHEN {u('missing:' + b)} >= {rate} THEN {a} END AS {b}")
        else:
            columns.append(f"{a} AS {b}")
    if leaks:
        boost = "" if v.boost is None else f" + CASE WHEN converted = 1 THEN {_poisson_sql(v.boost, u('boost'))} ELSE 0 END"
        columns.append(f"{'total_touches_all' if v.trap == 'all' else 'touches_after'}{boost} AS {v.leak}")
    return _world_sql(v.day) + f""", made AS (SELECT * REPLACE ({value} AS expected_acv, CAST(opportunity_created AS INTEGER) AS opportunity_created), CAST(demo_page_views > 0 AS INTEGER) AS demo_completed, CAST(converted_within_90_days AS INTEGER) AS converted, row_number() OVER (ORDER BY lead_created_at, lead_id) AS rn, count(*) OVER () AS n FROM snap),
waved AS (SELECT *, {wave} AS acquisition_wave, row_number() OVER (PARTITION BY converted ORDER BY {u('subsample')}, lead_id) AS place FROM made),
picked AS (SELECT * FROM waved WHERE place <= CASE converted WHEN 1 THEN {positives} ELSE {v.n - positives} END) SELECT {', '.join(columns)} FROM picked"""


for _day in (10, 30):
    QUERIES[f"lead_snapshot_day_{_day}"] = partial(lead_snapshot_at, _day)
    ORACLE[f"lead_snapshot_day_{_day}"] = _world_sql(_day) + " SELECT * EXCLUDE (touches_after) FROM snap"
for _name, _instructor in (("v4", False), ("v5", False), ("v6", False), ("v6", True), ("v7", True), ("midproject", False)):
    _key = f"flat_{_name}" + "_instructor" * _instructor
    QUERIES[_key] = partial(flat_version, _name, _instructor)
    ORACLE[_key] = _flat_sql(_name, _instructor)
for _key, _when, _cut in (("customer_snapshot_calendar", {"cutoff": CUTOFF}, f"DATE '{CUTOFF}'"), ("customer_snapshot_tenure", {"tenure_weeks": 60}, "start + 420")):
    QUERIES[_key] = partial(customer_snapshot_at, _when)
    ORACLE[_key] = _customers_sql(_cut)
