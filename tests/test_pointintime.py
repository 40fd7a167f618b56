import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tallyrand import api
from tallyrand.generate import leads, lifecycle
from tallyrand.operators import pointintime as P
from tallyrand.operators import snapshots as N
from tallyrand.sources import bundle

DAY0 = dt.date(2026, 1, 1)
on = lambda d: (DAY0 + dt.timedelta(days=d)).isoformat()


@pytest.fixture(scope="module")
def crm(spark):
    """Two leads at day 0, one of which converts at day 40."""
    make = spark.createDataFrame
    return {
        "accounts": make([("acct_1", "software", "created"), ("acct_2", "retail", "created")], "account_id string, industry string, created_at string"),
        "leads": make([("lead_1", "acct_1", on(0), "closed_won", True, True, on(40)), ("lead_2", "acct_2", on(0), "mql", False, False, None)], "lead_id string, account_id string, lead_created_at string, current_stage string, is_sql boolean, converted_within_90_days boolean, conversion_timestamp string"),
        "touches": make([("t1", "lead_1", on(0)), ("t2", "lead_1", on(5)), ("t3", "lead_1", on(12)), ("t4", "lead_2", on(35)), ("t5", "lead_9", on(1)), ("t6", "lead_1", "no date")], "touch_id string, lead_id string, touch_timestamp string"),
        "opportunities": make([("o1", "lead_1", on(8), "negotiation", 50000, "won", on(40)), ("o2", "lead_2", on(30), "sql", 60000, None, None)], "opportunity_id string, lead_id string, created_at string, stage string, estimated_acv long, close_outcome string, closed_at string"),
        "customers": make([("cu1", "o1")], "customer_id string, opportunity_id string"),
    }


def safe(tables, window):
    return P.safe_tables(tables, window=window, times=bundle.TIMES, banned=bundle.BANNED, omitted=bundle.OMITTED)


def ids(df):
    return sorted(r[0] for r in df.select(df.columns[0]).collect())


def test_safe_tables_cut_and_redact(crm):
    out = safe(crm, 10)
    assert ids(out["touches"]) == ["t1", "t2"] and ids(out["opportunities"]) == ["o1"]
    assert "customers" not in out
    assert not {"close_outcome", "closed_at", "stage"} & set(out["opportunities"].columns)
    assert out["leads"].columns == ["lead_id", "account_id", "lead_created_at"]


def test_window_zero_keeps_the_first_day(crm):
    assert ids(safe(crm, 0)["touches"]) == ["t1"]


def test_cutting_twice_changes_nothing(crm):
    once = safe(crm, 10)
    assert ids(safe(once, 10)["touches"]) == ids(once["touches"])


def test_optional_tables_may_be_absent(crm):
    assert set(safe({"leads": crm["leads"]}, 10)) == {"leads"}


def test_guards(spark, crm):
    with pytest.raises(P.SnapshotError):
        safe(crm, -1)
    with pytest.raises(P.SnapshotError):
        safe({k: v for k, v in crm.items() if k != "leads"}, 10)
    with pytest.raises(P.SnapshotError):
        safe(crm | {"leads": crm["leads"].drop("lead_created_at")}, 10)
    with pytest.raises(P.SnapshotError):
        safe(crm | {"leads": crm["leads"].union(crm["leads"])}, 10)
    for bad in (None, "soon"):
        with pytest.raises(P.SnapshotError):
            safe(crm | {"leads": crm["leads"].withColumn("lead_created_at", F.lit(bad).cast("string"))}, 10)


def test_touch_windows(spark):
    rows = spark.createDataFrame([("a", d) for d in (0, 3, 4, 7, 8, 10, 11)], "k string, day int")
    got = P.touch_features(rows, "k", 10, {}).first()
    assert (got.n_events, got.first_week, got.last_week, got.total_all) == (6, 4, 4, 7)


def test_forward_and_trailing_bounds(spark):
    rows = spark.createDataFrame([("a", d, 1.0) for d in (-12, -11, 0, 1, 90, 91)], "k string, day int, v double")
    assert P.forward_sums(rows, "k", F.col("day"), F.col("v"), F.lit(True), (90,)).first().revenue_90d == 2.0
    assert P.trailing(rows, "k", F.col("day"), 12, {"n": ("count", F.col("v"))}).first().n == 2


def test_first_open_skips_rows_without_a_value(spark):
    rows = spark.createDataFrame([("a", "o1", 1, None, None), ("a", "o2", 2, None, 5), ("a", "o3", 2, None, 7), ("a", "o4", 0, 3, 9)], "k string, id string, made int, closed int, v int")
    got = P.first_open(rows, "k", F.col("made"), F.col("closed"), F.lit(4), F.col("v"), F.col("id")).first()
    assert (got.any_created, got.has_open, got.open_value) == (True, True, 5)


@pytest.fixture(scope="module")
def lead_tables(spark):
    return leads.simulate(spark, leads.LeadWorld(n_accounts=20, n_contacts=40, n_leads=60))


def rows_of(df):
    """All rows as text; doubles to nine digits, as sums depend on the order of the rows."""
    return sorted(map(str, df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes)).collect()))


def test_lead_snapshot_ignores_what_comes_later(lead_tables):
    """Deleting all events after the cutoff changes no feature but the trap."""
    t = lead_tables
    safe_t = dict(t)
    for name, ts in bundle.TIMES.items():
        anchors = t["leads"].select("lead_id", F.to_date("lead_created_at").alias("anchor"))
        safe_t[name] = P.with_day(t[name], anchors, "lead_id", ts).where("day <= 30").select(t[name].columns)
    a, b = (N.lead_snapshot(x, window=30).drop("total_touches_all") for x in (t, safe_t))
    assert rows_of(a) == rows_of(b)


def test_lead_snapshot_catalogue_and_monotone(lead_tables):
    a, b = N.lead_snapshot(lead_tables, window=10), N.lead_snapshot(lead_tables, window=None)
    assert a.columns == [f.name for f in N.LEAD_FEATURES] and len(a.columns) == 33
    both = a.select("lead_id", F.col("touch_count").alias("x"), F.col("total_touches_all").alias("t")).join(b.select("lead_id", F.col("touch_count").alias("y")), "lead_id")
    assert both.count() == 60 and both.where("x > y or y <> t").count() == 0


def test_whole_history_is_as_of_the_horizon(lead_tables):
    """Without a window recencies and the last week end at the horizon, not at the last touch."""
    touches, leads_ = ([r.asDict() for r in lead_tables[t].collect()] for t in ("touches", "leads"))
    made = {r["lead_id"]: dt.date.fromisoformat(r["lead_created_at"][:10]) for r in leads_}
    days = {}
    for r in touches:
        days.setdefault(r["lead_id"], []).append((dt.date.fromisoformat(r["touch_timestamp"][:10]) - made[r["lead_id"]]).days)
    for r in N.lead_snapshot(lead_tables, window=None, horizon=90).collect():
        own = days.get(r.lead_id, [])
        assert r.touches_last_7_days == sum(d > 83 for d in own)
        assert (r.days_since_first_touch, r.days_since_last_touch) == ((90 - min(own), 90 - max(own)) if own else (None, None))


def test_tiers_distort_their_snapshots(spark, lead_tables):
    plain = N.lead_snapshot(lead_tables, window=30).cache()
    out = {t: {r.lead_id: r for r in N.made_difficult(plain, N.LEAD_FEATURES, "lead_id", d, 42).collect()} for t, d in api.DIFFICULTIES.items()}
    was = {r.lead_id: r for r in plain.collect()}
    gone = lambda rows: sum(r[f.name] is None and was[i][f.name] is not None for i, r in rows.items() for f in N.LEAD_FEATURES)
    assert 0 < gone(out["intro"]) < gone(out["intermediate"]) < gone(out["advanced"])
    for rows in out.values():
        assert rows.keys() == was.keys()
        for f in N.LEAD_FEATURES:
            for i, r in rows.items():
                if f.role != "feature" or f.dtype not in ("double", "long"):
                    assert r[f.name] == was[i][f.name]
                elif f.dtype == "long":
                    assert r[f.name] in (None, was[i][f.name])


def test_world_rules(lead_tables):
    t = lead_tables
    assert t["customers"].count() == t["leads"].where("current_stage = 'closed_won'").count()
    late = t["touches"].join(t["leads"].where("conversion_timestamp is not null"), "lead_id").where("touch_timestamp > conversion_timestamp")
    assert late.count() == 0
    assert t["opportunities"].groupBy("lead_id").count().where("count > 1").count() == 0


def test_worlds_do_not_depend_on_partitions(spark):
    world = lifecycle.LifecycleWorld(n_customers=40, weeks=80)
    a = rows_of(lifecycle.simulate(spark, world)["subscription_events"])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows_of(lifecycle.simulate(spark, world)["subscription_events"]) == a
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def customer_tables(spark):
    return lifecycle.simulate(spark, lifecycle.LifecycleWorld(n_customers=60))


def test_customer_snapshot(customer_tables):
    t, cut = customer_tables, "2023-06-05"
    a = N.customer_snapshot(t, cutoff=cut)
    assert a.columns == [f.name for f in N.CUSTOMER_FEATURES] and len(a.columns) == 27
    assert a.where("ltv_revenue_90d > ltv_revenue_365d or ltv_revenue_365d > ltv_revenue_730d").count() == 0
    cutoff = dict(t)
    for name, ts in (("subscription_events", "event_timestamp"), ("health_signals", "period_start"), ("invoices", "invoice_date")):
        cutoff[name] = P.until(t[name], ts, cut)
    targets = [f.name for f in N.CUSTOMER_FEATURES if f.role in ("target", "trap")]
    assert rows_of(a.drop(*targets)) == rows_of(N.customer_snapshot(cutoff, cutoff=cut).drop(*targets))


def test_snapshots_without_later_health(spark, customer_tables):
    """Health signals that no row of a snapshot reads aren't made; nothing else changes."""
    for weeks, options in ((5, {"tenure_weeks": 4}), (75, {"cutoff": "2023-06-05"})):
        t = lifecycle.simulate(spark, lifecycle.LifecycleWorld(n_customers=60), health_weeks=weeks)
        assert t["health_signals"].count() < customer_tables["health_signals"].count() * weeks / 100
        assert all(rows_of(t[name]) == rows_of(customer_tables[name]) for name in ("customers", "subscriptions", "subscription_events", "invoices"))
        assert rows_of(N.customer_snapshot(t, **options)) == rows_of(N.customer_snapshot(customer_tables, **options))


def test_customer_snapshot_guards(customer_tables):
    with pytest.raises(P.SnapshotError):
        N.customer_snapshot(customer_tables)
    with pytest.raises(P.SnapshotError):
        N.customer_snapshot(customer_tables, cutoff="2024-06-03", weeks=182)
    with pytest.raises(P.SnapshotError):
        N.customer_snapshot(customer_tables, tenure_weeks=80, weeks=182)
    assert N.customer_snapshot(customer_tables, cutoff="2023-06-05", weeks=182).count() > 0
    early = N.customer_snapshot(customer_tables, tenure_weeks=4)
    assert {r.tenure_weeks for r in early.select("tenure_weeks").distinct().collect()} == {4}


def test_ltv_against_plain_sums(customer_tables):
    t, cut = customer_tables, dt.date(2023, 6, 5)
    want = {}
    for r in t["invoices"].collect():
        d = (dt.date.fromisoformat(r.invoice_date) - cut).days
        if r.payment_status in ("paid", "recovered") and 0 < d <= 365:
            want[r.customer_id] = want.get(r.customer_id, 0) + r.amount_usd
    got = {r.customer_id: r.ltv_revenue_365d for r in N.customer_snapshot(t, cutoff=cut.isoformat()).collect()}
    assert got and all(v == want.get(k, 0) for k, v in got.items())


def test_small_poisson_counts_are_compared_before_the_loop(spark):
    from tallyrand.functions.random import poisson

    def walked(rate, u, most):
        p = c = math.exp(-rate)
        k = 0
        for i in range(1, most + 1):
            if u < c:
                break
            p, k = p * rate / i, i
            c += p
        return k

    cases = [(r, u, m) for m in (1, 2, 12) for r in (0.02, 0.5, 3.0, 9.0) for u in (0.0, 0.3, 0.6, 0.9, 0.99, 0.9999, 1 - 2**-53)]
    for m in (1, 2, 12):
        rows = spark.createDataFrame([(r, u) for r, u, k in cases if k == m], "r double, u double").withColumn("k", poisson(F.col("r"), F.col("u"), m)).collect()
        assert [x.k for x in rows] == [walked(x.r, x.u, m) for x in rows]
    made = str(poisson(F.col("r"), F.col("u"), 12))
    assert made.index("CASE WHEN") < made.index("aggregate(")


def test_wide_rows_are_written_by_split_code(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    name, seen, whole = "spark.sql.codegen.hugeMethodLimit", [], DataFrame.checkpoint
    before = spark.conf.get(name)
    monkeypatch.setattr(DataFrame, "checkpoint", lambda df, *a: (seen.append(spark.conf.get(name)), whole(df, *a))[1])
    leads.simulate(spark, leads.LeadWorld(n_accounts=5, n_contacts=5, n_leads=5))
    assert seen == ["8000", "8000"] and spark.conf.get(name) == before


def test_settled_invoices_and_usage_out_of_reach_need_no_shuffle(spark):
    made = lifecycle.simulate(spark, lifecycle.LifecycleWorld(n_customers=300))
    states = {r.payment_status: r["count"] for r in made["invoices"].groupBy("payment_status").count().collect()}
    assert {"paid", "recovered", "written_off"} <= set(states)
    assert made["invoices"].count() == made["invoices"].select("invoice_id").distinct().count()
    for name in ("invoices", "health_signals", "subscription_events"):
        assert "Join" not in made[name]._jdf.queryExecution().optimizedPlan().toString()
    whole = N.customer_snapshot(made, tenure_weeks=20, weeks=182)
    near = made | {"health_signals": made["health_signals"].where("period_start < '2023-06-13'"), "invoices": made["invoices"].where("invoice_date > '2022-05-22'")}
    assert sorted(map(str, N.customer_snapshot(near, tenure_weeks=20).collect())) == sorted(map(str, whole.collect()))
