"""Queries on families of datasets: priorities of orders are tiers, fifths of them seeds; with SQL for the same rows where no model is learnt."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.random import fast_uniform, uniform
from ..operators import models as M
from ..operators import quality as Q
from ..operators import ranking as R
from ..operators import release as L
from ..sources.tables import read_table
from .audits import SEED, u_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


_Y = "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END"
_RUN = f"CAST(floor({u_sql('run', 'o_orderkey')} * 5) AS BIGINT)"
KS, PERCENTS = (5, 50), (1, 5, 10)


def _runs(spark: SparkSession, d: str, *more: str) -> DataFrame:
    o = read_table(spark, d, "orders", ["o_orderkey", "o_orderpriority", "o_orderstatus", *more])
    seed = F.floor(uniform(SEED, "run", F.col("o_orderkey")) * 5).cast("long")
    return o.select("o_orderkey", F.col("o_orderpriority").alias("tier"), seed.alias("seed"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), *more)


def _panel_sql() -> str:
    k = lambda p: f"CAST(greatest(1, round_even(n * {p}::DOUBLE / 100, 0)) AS BIGINT)"
    top = lambda p: f"sum(CASE WHEN rn <= {k(p)} THEN y ELSE 0 END) / max({k(p)})::DOUBLE"
    values = {"n": "count(*)::DOUBLE", "rate": "avg(y)", "brier": "avg((p - y) * (p - y))", "log_loss": "avg(-(y * ln(q) + (1 - y) * ln(1 - q)))"}
    for c in KS:
        hits = f"sum(CASE WHEN rn <= {c} THEN y ELSE 0 END)"
        values |= {f"precision_at_{c}": f"CASE WHEN count(*) >= {c} THEN {hits} / {c}::DOUBLE END", f"recall_at_{c}": f"CASE WHEN count(*) >= {c} THEN {hits} / nullif(sum(y), 0)::DOUBLE END"}
    values |= {f"lift_at_{p}": f"{top(p)} / nullif(avg(y), 0)" for p in PERCENTS} | {"top_decile_rate": top(10)}
    one = ", ".join(f"{v} AS {name}" for name, v in values.items())
    names = ", ".join([*values, "calibration_max_error", "auc", "average_precision"])
    return f"""WITH s AS (SELECT o_orderkey, o_orderpriority AS tier, {_RUN} AS seed, {_Y} AS y, (o_custkey % 97) / 96.0::DOUBLE AS p FROM orders),
r AS (SELECT *, greatest(1e-15, least(1 - 1e-15, p)) AS q, row_number() OVER (PARTITION BY tier, seed ORDER BY p DESC, o_orderkey) AS rn, count(*) OVER (PARTITION BY tier, seed) AS n FROM s),
one AS (SELECT tier, seed, {one} FROM r GROUP BY ALL),
cal AS (SELECT tier, seed, max(e) AS calibration_max_error FROM (SELECT tier, seed, abs(avg(p) - avg(y)) AS e FROM s GROUP BY tier, seed, least(9, floor(p * 10))) GROUP BY ALL),
g AS (SELECT tier, seed, p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM s GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER o AS cp, sum(neg) OVER o AS cn, sum(pos) OVER a AS ap, sum(neg) OVER a AS an FROM g WINDOW o AS (PARTITION BY tier, seed ORDER BY p DESC), a AS (PARTITION BY tier, seed)),
m AS (SELECT tier, seed, sum(neg * (cp - pos / 2)) / nullif(max(ap) * max(an), 0) AS auc, CASE WHEN max(ap) > 0 THEN sum(pos / ap * (cp / (cp + cn))) END AS average_precision FROM c GROUP BY ALL),
w AS (SELECT * FROM one JOIN cal USING (tier, seed) JOIN m USING (tier, seed))
SELECT tier, seed, metric, round(value, 6) AS value FROM w UNPIVOT INCLUDE NULLS (value FOR metric IN ({names}))"""


@query(_panel_sql())
def release_metrics(spark: SparkSession, d: str) -> DataFrame:
    """All metrics of every tier and seed at once, for a score with many ties."""
    rows = _runs(spark, d, "o_custkey").withColumns({"p": (F.col("o_custkey") % 97) / 96.0, "set": F.struct("tier", "seed")})
    out = R.panel_by_group(rows, "set", ["o_orderkey"], ks=KS, percents=PERCENTS)
    return out.select("set.tier", "set.seed", "metric", F.round("value", 6).alias("value"))


#: Priorities that stand for tiers, easiest first; the last isn't there.
TIERS = ("1-URGENT", "3-MEDIUM", "5-LOW", "9-NONE")
GATES = {
    "per_tier": {"1-URGENT": {"rate_test": {"min": 0.45, "max": 0.47}, "won": {"max": 0.9}}, "3-MEDIUM": {"rate_test": {"min": 0.6}, "margin": {"min": 0}}, "9-NONE": {"rate_test": {"min": 0.1}}},
    "cross_seed_spread": {"rate_test": {"max": 0.02}, "won": {"min": 0.0, "max": 0.9}, "margin": {"max": 0.1}},
    "cohort_shift": {"auc_degradation": {"min": 0.0, "max": 0.05}},
    "cross_tier_required": ["5-LOW", "9-NONE"],
    "leakage_probes": {"label_drift_max": 0.01, "id_only_max_auc": 0.6, "feature_subsets": {"late": {"max_auc": 0.4, "columns": ["late"]}}},
}


def _gates_sql() -> str:
    v = lambda rows: "(VALUES " + ", ".join("(" + ", ".join("NULL::DOUBLE" if x is None else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x).lower() if isinstance(x, bool) else f"'{x}'" for x in r) + ")" for r in rows) + ")"
    g = L.load_gates(json.dumps(GATES))
    pairs = [(m, a, b, {a, b} <= set(g.required)) for m in ("rate_test", "won") for a, b in zip(TIERS, TIERS[1:], strict=False)]
    why = "CASE WHEN value IS NULL THEN 'missing' WHEN value < low THEN 'below' WHEN value > high THEN 'above' END"
    split = f"CASE WHEN {u_sql('part', 'o_orderkey')} < 0.5 THEN 'a' ELSE 'b' END"
    return f"""WITH s AS (SELECT *, o_orderpriority AS tier, {_RUN} AS seed, {_Y} AS y FROM orders),
m AS (SELECT tier, seed, 'rate_test' AS metric, avg(y) AS value FROM s GROUP BY ALL UNION ALL SELECT tier, seed, 'won', sum(y * o_totalprice) / sum(o_totalprice) FROM s GROUP BY ALL UNION ALL SELECT tier, seed, 'lr:late_auc', avg(CASE WHEN o_orderdate >= TIMESTAMP '1995-06-01 00:00:00' THEN 1 ELSE 0 END) FROM s GROUP BY ALL),
x AS (SELECT tier, metric, quantile_cont(value, 0.5) AS median, max(value) - min(value) AS spread FROM m GROUP BY ALL),
h AS (SELECT tier, avg(y) FILTER (WHERE month(o_orderdate) <= 6) - avg(y) FILTER (WHERE month(o_orderdate) > 6) AS value FROM s GROUP BY 1),
f AS (SELECT tier, max(e) AS value FROM (SELECT tier, seed, max(r) - min(r) AS e FROM (SELECT tier, seed, {split} AS part, avg(y) AS r FROM s GROUP BY ALL) GROUP BY ALL) GROUP BY 1),
b(tier, metric, low, high) AS {v(g.tiers)}, p(metric, low, high) AS {v(g.spread)}, o(metric, tier, harder, needed) AS {v(pairs)},
u AS (SELECT 'tier' AS gate, tier, metric, median AS value, low, high FROM b LEFT JOIN x USING (tier, metric) UNION ALL SELECT 'spread', tier, metric, spread, low, high FROM x JOIN p USING (metric)
 UNION ALL SELECT 'cohort', tier, 'auc_degradation', value, 0.0::DOUBLE, 0.05::DOUBLE FROM h),
q AS (SELECT 'order' AS gate, o.tier, o.metric, a.median AS value, z.median AS low, CASE WHEN a.median IS NULL OR z.median IS NULL THEN CASE WHEN needed THEN 'undefined against ' || harder END WHEN a.median <= z.median THEN 'not above ' || harder END AS reason
 FROM o LEFT JOIN x a ON a.metric = o.metric AND a.tier = o.tier LEFT JOIN x z ON z.metric = o.metric AND z.tier = o.harder),
e AS (SELECT gate, tier, metric, value, low, high, {why} AS reason FROM u UNION ALL SELECT gate, tier, metric, value, low, NULL, reason FROM q
 UNION ALL SELECT 'gain', NULL, 'gbt_minus_lr_auc', NULL, NULL, NULL, 'undefined' UNION ALL SELECT 'leakage', tier, metric, max(value), NULL, 0.4, CASE WHEN max(value) > 0.4 THEN 'above' END FROM m WHERE metric = 'lr:late_auc' GROUP BY tier, metric
 UNION ALL SELECT 'leakage', tier, 'label_drift', value, NULL, 0.01, CASE WHEN value > 0.01 THEN 'above' END FROM f)
SELECT gate, tier, metric, round(value, 6) AS value, round(low, 6)::DOUBLE AS low, high::DOUBLE AS high, reason FROM e WHERE reason IS NOT NULL"""


@query(_gates_sql())
def release_gates(spark: SparkSession, d: str) -> DataFrame:
    """Every kind of gate, failed and passed, over rates by tier and seed, with a tier and a metric that aren't there."""
    rows = _runs(spark, d, "o_totalprice", "o_orderdate")
    late = (F.col("o_orderdate") >= F.lit("1995-06-01").cast("timestamp")).cast("int")
    per = rows.groupBy("tier", "seed").agg(F.avg("y").alias("rate_test"), F.try_divide(F.sum(F.col("y") * F.col("o_totalprice")), F.sum("o_totalprice")).alias("won"), F.avg(late).alias("lr:late_auc"))
    half = F.month("o_orderdate") <= 6
    shifts = rows.groupBy("tier").agg((F.avg(F.when(half, F.col("y"))) - F.avg(F.when(~half, F.col("y")))).alias("degradation"))
    drifts = L.label_drifts(rows.withColumn("part", F.when(uniform(SEED, "part", F.col("o_orderkey")) < 0.5, "a").otherwise("b")), "tier", "seed", "part", "y")
    found = per.unpivot(["tier", "seed"], ["rate_test", "won", "lr:late_auc"], "metric", "value")
    out = L.failures(found, L.load_gates(json.dumps(GATES)), shifts=shifts, drifts=drifts, tiers=TIERS, falling=("rate_test", "won"))
    return out.withColumns({c: F.round(c, 6) for c in ("value", "low")})


FEATURES = ["o_totalprice", "o_custkey", "month", "clerk"]


def family(spark: SparkSession, d: str) -> DataFrame:
    """Orders as datasets of three tiers, with features, hashes of the key and a training flag."""
    rows = _runs(spark, d, "o_totalprice", "o_custkey", "o_orderdate").withColumns({"month": F.month("o_orderdate"), "clerk": F.concat(F.lit("c"), F.col("o_custkey") % 7)})
    return rows.where(F.col("tier").isin(*TIERS)).withColumn("train", fast_uniform(5, "train", F.col("o_orderkey")) < 0.7).select("*", *M.hashed_id(F.col("o_orderkey")))


def _day(of: str) -> Column:
    return F.unix_micros(F.col(of).cast("timestamp"))


@query()
def release_report(spark: SparkSession, d: str) -> DataFrame:
    """Linear and boosted models of every tier and seed, a subset's and an id's probe and cohort shifts, in the passes of one model."""
    rows = family(spark, d)
    scored = L.scores(rows, "tier", "seed", "o_orderkey", FEATURES, "y", F.col("train"), subsets={"month": ["month"], "id_only": ["h0", "h1", "h2", "h3"]})
    shifts = L.cohort_shifts(rows, "tier", "seed", "o_orderkey", _day("o_orderdate"), FEATURES, "y", draw=fast_uniform(6, "cohort", F.col("o_orderkey")))
    return L.report(L.metrics(scored), shifts.groupBy("tier").agg(F.min_by("degradation", "seed").alias("degradation")))


@query()
def flat_validation(spark: SparkSession, d: str) -> DataFrame:
    """All checks of a flat dataset of orders with two columns that leak, one more than the other, its baseline and what the leaks add among them."""
    leak = lambda name, share: ((F.col("y") == 1) & (fast_uniform(7, name, F.col("o_orderkey")) < share)).cast("int").alias(name)
    rows = read_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"]).withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    rows = rows.select("o_orderkey", "o_totalprice", "o_orderpriority", (F.col("o_custkey") % 50).alias("grp"), "y", leak("leakage_open", 0.6), leak("leakage_faint", 0.01))
    return Q.flat_validation(rows, key="o_orderkey", columns=rows.columns, label="y", value="o_totalprice", groups=["grp"], auc=(0.4, 0.7), rate=(0.15, 0.6), trap_mean=0.05)
