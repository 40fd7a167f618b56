"""Reports on a family of published datasets, tiers of difficulty by seeds, and the gates that they must pass.

All tiers' and seeds' models are fitted and scored together: linear models, those of feature subsets among them, take a pass a step, boosted trees a pass a level, and one aggregation makes all metrics, whatever the number of datasets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from ..functions.random import fast_uniform
from ..sources import bundle
from ..sources.bundle import bands_of, bounds_of, load_yaml
from ..sources.tables import materialised
from . import joint
from . import models as M
from . import quality as Q
from . import ranking as R

#: Datasets that are fitted together at most: their keys and models are the driver's.
MOST = 256
#: Metrics that must fall from each tier to the next harder one.
FALLING = ("lr_average_precision", "precision_at_100", "rate_test")
FAILURE = "gate string, tier string, metric string, value double, low double, high double, reason string"


def _numbered(rows: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame, int]:
    """(rows with the number _set of their dataset instead of (_tier, _seed), the datasets (_set, tier, seed), how many there are); more than ``most`` raise."""
    sets = rows.select("_tier", "_seed").distinct().orderBy("_tier", "_seed").limit(most + 1).collect()
    if len(sets) > most:
        raise ValueError(f"more than {most} datasets")
    names = rows.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(sets)], "_set int, tier string, seed long")
    return rows.join(F.broadcast(names), F.col("_tier").eqNullSafe(F.col("tier")) & F.col("_seed").eqNullSafe(F.col("seed"))).drop("_tier", "_seed", "tier", "seed"), names, len(sets)


def scores(rows: DataFrame, tier: str, seed: str, key: str, features: Sequence[str], label: str, train: Column, *, subsets: Mapping[str, Sequence[str]] | None = None, bins: int = 32, **options) -> DataFrame:
    """(tier, seed, key, model, y, p), written: the rows that ``train`` isn't true for, scored by models learnt on the training rows of the same tier and seed: "lr", "gbt" and, for each subset of columns, the linear "lr:<name>".

    Rows whose label isn't 0 or 1 are left out. Medians, scales and bins are those of all datasets together. A dataset without training rows gives scores of one half. Columns of subsets needn't be among the features. options: of joint.boosting().
    """
    subsets = dict(subsets or {})
    columns = list(dict.fromkeys([*features, *(c for own in subsets.values() for c in own)]))
    name = {c: f"_f{i}" for i, c in enumerate(columns)}
    base = rows.where(F.col(label).cast("int").isin(0, 1)).select(F.col(tier).cast("string").alias("_tier"), F.col(seed).cast("long").alias("_seed"), F.col(key).alias("_key"), F.coalesce(train, F.lit(False)).alias("_train"), F.col(label).cast("double").alias("_label"), *(F.col(c).alias(f) for c, f in name.items()))
    base, names, n = _numbered(base)
    base = materialised(base)
    own = [name[c] for c in features]
    numeric, categorical = M.partitioned(base.select(*own), [])
    placed = M.bins_of(base.where("_train"), numeric, categorical, bins)
    ready, shape, places = M.prepared(base, [*name.values()], "_label", ["_set", "_key", "_train", *own], written=False)
    seen = {"lr": features} | {f"lr:{s}": of for s, of in subsets.items()}
    weights = joint.fit_sets(ready.where("_train"), shape, "_set", n, [tuple(p for c in of for p in places[name[c]]) for of in seen.values()], l2=M.RIDGE)
    counts = joint.counted(base.where("_train").select("_set", F.col("_label").alias("y"), placed), "_set")
    boosted = joint.fit_boosted_counts(counts, "_set", len(own), bins, n, **options)
    judged = joint.predicted_sets(ready.where("not _train"), shape, weights, "_set", ["_set", "_key", "y", *own])
    # Bins are told behind the linear models: with what prepares those, the generated method would be too long for the JVM to compile.
    judged = joint.predict_boosted_sets(judged.select("_set", "_key", "y", F.col("p").alias("_linear"), placed), boosted, "_set", ["_set", "_key", "y", "_linear"])
    each = F.array(*(F.struct(F.lit(m).alias("model"), F.col("_linear")[j].alias("p")) for j, m in enumerate(seen)), F.struct(F.lit("gbt").alias("model"), F.col("p").alias("p")))
    out = judged.select("_set", "_key", "y", F.explode(each).alias("_m")).join(F.broadcast(names), "_set")  # a row a dataset
    return materialised(out.select("tier", "seed", F.col("_key").alias("key"), "_m.model", F.col("y").cast("int").alias("y"), "_m.p"))


def metrics(scored: DataFrame, *, ks: Sequence[int] = (50, 100), percents: Sequence[float] = (1, 5, 10)) -> DataFrame:
    """(tier, seed, metric, value) of scores(): rate_test, every model's AUC and average precision, what boosted trees gain over the linear model, and the linear model's losses, calibration, precision, recall and lift.

    Only the linear model's rows are ranked; of the others' scores, the distinct ones are counted.
    """
    rows = scored.withColumns({"_set": F.struct("tier", "seed", "model"), "p": F.round("p", 12)})
    linear = R.panel_by_group(rows.where("model = 'lr'"), "_set", ["key"], ks=ks, percents=percents).select("_set.*", "metric", "value")
    others = R.metrics_by_group(rows.where("model != 'lr'"), "_set").select("_set.*", "auc", "average_precision").unpivot(["tier", "seed", "model"], ["auc", "average_precision"], "metric", "value")
    found = materialised(linear.unionByName(others))  # a row for each dataset, model and metric
    name = F.when(F.col("metric").isin("auc", "average_precision"), F.concat_ws("_", "model", "metric")).when(F.col("metric") == "rate", F.lit("rate_test")).otherwise(F.col("metric"))
    own = found.select("tier", "seed", name.alias("metric"), "value")
    gain = found.where((F.col("metric") == "auc") & F.col("model").isin("lr", "gbt")).groupBy("tier", "seed").agg((F.max(F.when(F.col("model") == "gbt", F.col("value"))) - F.max(F.when(F.col("model") == "lr", F.col("value")))).alias("value"))
    return own.unionByName(gain.select("tier", "seed", F.lit("gbt_minus_lr_auc").alias("metric"), "value"))


def report(found: DataFrame, shifts: DataFrame | None = None) -> DataFrame:
    """(section, tier, seed, metric, value) of metrics(): each seed's values, their medians and spreads by tier, the tiers' places by falling median and, given (tier, degradation), the shifts of cohorts."""
    found = materialised(found)  # a row for each dataset and metric
    across = Q.across_seeds(found)
    row = lambda df, section, tier, seed, value: df.select(F.lit(section).alias("section"), F.col(tier).alias("tier"), seed.cast("long").alias("seed"), "metric", value.cast("double").alias("value"))
    none = F.lit(None)
    tiers = [r[0] for r in found.select("tier").distinct().collect()]
    places = Q.tier_order(across.where(F.col("metric").isin(*FALLING, "gbt_minus_lr_auc")), [t for t in Q.TIERS if t in tiers] + sorted(t for t in tiers if t not in Q.TIERS))
    parts = [row(found, "seed", "tier", F.col("seed"), F.col("value")), row(across, "median", "tier", none, F.col("median")), row(across, "spread", "tier", none, F.col("spread")), row(places, "place", "tier", none, F.col("place"))]
    if shifts is not None:
        parts.append(row(shifts.withColumn("metric", F.lit("auc_degradation")), "cohort", "tier", none, F.col("degradation")))
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Gates:
    """Bounds, a missing one being None. tiers: (tier, metric, low, high) of medians; spread: (metric, low, high) of every tier's spread over seeds; cohort: (low, high) of every tier's degradation;
    required: tiers that must be there for their order to be judged; subsets: name -> (highest AUC, columns) of probes; id_only, drift: the highest AUC of an id's hashes and the largest difference of splits' label rates."""

    tiers: tuple[tuple[str, str, float | None, float | None], ...] = ()
    spread: tuple[tuple[str, float | None, float | None], ...] = ()
    cohort: tuple[float | None, float | None] | None = None
    required: tuple[str, ...] = ()
    subsets: Mapping[str, tuple[float, tuple[str, ...]]] = field(default_factory=dict)
    id_only: float | None = None
    drift: float | None = None


#: Sections of a file of gates.
SECTIONS = ("per_tier", "cross_seed_spread", "cohort_shift", "cross_tier_required", "leakage_probes")


def load_gates(text: str) -> Gates:
    """Gates from YAML or JSON with any of the SECTIONS; a missing section sets no gate. Unknown sections and bounds, and bands without a bound, raise."""
    held = load_yaml(text) or {}
    if not isinstance(held, Mapping) or (unknown := set(held) - set(SECTIONS)):
        raise ValueError(f"gates must be a mapping of {SECTIONS}; got {sorted(unknown) if isinstance(held, Mapping) else held!r}")
    tiers = bands_of(held.get("per_tier"))
    spread = [(m, *bounds_of(f"cross_seed_spread.{m}", b)) for m, b in (held.get("cross_seed_spread") or {}).items()]
    shift = held.get("cohort_shift") or {}
    cohort = bounds_of("cohort_shift", shift.get("auc_degradation", shift)) if shift else None
    for name, low, high in [*((f"{t}.{m}", lo, hi) for t, m, lo, hi in tiers), *spread, *([("cohort_shift", *cohort)] if cohort else [])]:
        if low is None and high is None:
            raise ValueError(f"{name} has neither min nor max")
    probes = held.get("leakage_probes") or {}
    subsets = {}
    for name, own in (probes.get("feature_subsets") or {}).items():
        if not isinstance(own, Mapping) or not {"max_auc", "columns"} <= set(own) or not isinstance(own["columns"], list) or not all(isinstance(c, str) for c in own["columns"]):
            raise ValueError(f"leakage_probes.feature_subsets.{name} needs max_auc and columns, a list of names")
        subsets[str(name)] = (float(own["max_auc"]), tuple(own["columns"]))
    number = lambda c: None if probes.get(c) is None else float(probes[c])
    return Gates(tuple(tiers), tuple(spread), cohort, tuple(held.get("cross_tier_required") or ()), subsets, number("id_only_max_auc"), number("label_drift_max"))


def _outside(value: Column, low: Column, high: Column) -> Column:
    """Why a value isn't within its bounds; null where it is."""
    return F.when(value.isNull() | F.isnan(value), "missing").when(value < low, "below").when(value > high, "above")


def failures(found: DataFrame, gates: Gates, *, shifts: DataFrame | None = None, drifts: DataFrame | None = None, tiers: Sequence[str] = Q.TIERS, falling: Sequence[str] = FALLING) -> DataFrame:
    """(gate, tier, metric, value, low, high, reason), a row for each gate that metrics() fail.

    tier: a median outside its band, or missing. spread: a tier's spread over seeds; metrics that the tier lacks set none. cohort: of shifts (tier, degradation). order: a tier's median of a ``falling`` metric that isn't above the next harder tier's
    (low: the latter); where one is missing, only if both tiers are required. gain: no tier says what boosted trees gain, though tiers are required. leakage: the AUC of a subset (lr:<name>) with any seed, of "lr:id_only", and drifts (tier, drift).
    """
    spark = found.sparkSession
    found = materialised(found)  # a row for each dataset and metric
    across = materialised(Q.across_seeds(found.where(~F.isnan("value"))))
    low, high, value = F.col("low"), F.col("high"), F.col("value")
    made = lambda df, gate: df.select(F.lit(gate).alias("gate"), "tier", "metric", F.col("value").cast("double").alias("value"), F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), "reason").where(F.col("reason").isNotNull())
    bands = spark.createDataFrame([*gates.tiers], "tier string, metric string, low double, high double")
    out = [made(bands.join(across, ["tier", "metric"], "left").withColumn("value", F.col("median")).withColumn("reason", _outside(value, low, high)), "tier")]
    spreads = spark.createDataFrame([*gates.spread], "metric string, low double, high double")
    out.append(made(across.join(F.broadcast(spreads), "metric").withColumn("value", F.col("spread")).withColumn("reason", _outside(value, low, high)), "spread"))
    if gates.cohort and shifts is not None:
        bounds = {"low": F.lit(gates.cohort[0]).cast("double"), "high": F.lit(gates.cohort[1]).cast("double"), "metric": F.lit("auc_degradation"), "value": F.col("degradation")}
        out.append(made(shifts.withColumns(bounds).withColumn("reason", _outside(value, low, high)), "cohort"))
    pairs = [(m, a, b, {a, b} <= set(gates.required)) for m in falling for a, b in zip(tiers, tiers[1:], strict=False)]
    pairs = spark.createDataFrame(pairs, "metric string, tier string, harder string, needed boolean")
    side = lambda tier, name: across.select("metric", F.col("tier").alias(tier), F.col("median").alias(name))
    both = pairs.join(side("tier", "value"), ["metric", "tier"], "left").join(side("harder", "low"), ["metric", "harder"], "left").withColumn("high", F.lit(None))
    lacking = value.isNull() | low.isNull()
    out.append(made(both.withColumn("reason", F.when(lacking & F.col("needed"), F.concat(F.lit("undefined against "), "harder")).when(~lacking & (value <= low), F.concat(F.lit("not above "), "harder"))), "order"))
    if gates.required:
        gains = across.where(F.col("metric") == "gbt_minus_lr_auc").agg(F.count("*").alias("n"))
        out.append(made(gains.select(F.lit(None).cast("string").alias("tier"), F.lit("gbt_minus_lr_auc").alias("metric"), *(F.lit(None).alias(c) for c in ("value", "low", "high")), F.when(F.col("n") == 0, "undefined").alias("reason")), "gain"))
    limits = [(f"lr:{name}_auc", most) for name, (most, _) in gates.subsets.items()] + ([] if gates.id_only is None else [("lr:id_only_auc", gates.id_only)])
    if limits:
        learnt = found.join(F.broadcast(spark.createDataFrame(limits, "metric string, high double")), "metric").groupBy("tier", "metric", "high").agg(F.max("value").alias("value"))
        out.append(made(learnt.withColumns({"low": F.lit(None), "reason": F.when(value > high, "above")}), "leakage"))
    if gates.drift is not None and drifts is not None:
        out.append(made(drifts.withColumns({"metric": F.lit("label_drift"), "value": F.col("drift"), "low": F.lit(None), "high": F.lit(gates.drift)}).withColumn("reason", F.when(value > high, "above")), "leakage"))
    return reduce(DataFrame.unionByName, out)


def label_drifts(rows: DataFrame, tier: str, seed: str, split: str, label: str) -> DataFrame:
    """(tier, drift): the largest difference of the label's rate between two splits of one dataset, over the tier's seeds; null labels count as false. One aggregation for all datasets."""
    rates = rows.groupBy(F.col(tier).cast("string").alias("tier"), F.col(seed).alias("_seed"), split).agg(F.avg(F.coalesce(F.col(label).cast("int"), F.lit(0))).alias("_rate"))
    return rates.groupBy("tier", "_seed").agg((F.max("_rate") - F.min("_rate")).alias("_d")).groupBy("tier").agg(F.max("_d").alias("drift"))


def cohort_shifts(rows: DataFrame, tier: str, seed: str, key: str, time: Column, features: Sequence[str], label: str, *, early: float = 0.85, draw: Column, test_share: float = 0.15, bins: int = 32, **options) -> DataFrame:
    """(tier, seed, random_auc, cohort_auc, degradation) of every dataset: boosted trees tested on the rows with draws below ``test_share``, and learnt on the earliest ``early`` share of the dataset's rows and tested on the rest.

    All datasets' models, both kinds, are fitted together, on counts of equal rows; half of MOST datasets at most. Null times come last; time must be a number. options: of joint.boosting().
    """
    name = {c: f"_f{i}" for i, c in enumerate(dict.fromkeys(features))}
    own = rows.where(F.col(label).cast("int").isin(0, 1)).select(F.col(tier).cast("string").alias("_tier"), F.col(seed).cast("long").alias("_seed"), F.col(key).alias("_key"), (-time).alias("_time"), F.coalesce(draw >= test_share, F.lit(False)).alias("_random"), F.col(label).cast("double").alias("y"), *(F.col(c).alias(f) for c, f in name.items()))
    own, names, n = _numbered(own, MOST // 2)
    early_on = F.col("rn") <= F.bround(F.col("n") * early)
    base = materialised(R.ranked_in_groups(own, "_set", "_time", ["_key"]).select("_set", "_random", early_on.alias("_cohort"), "y", *name.values()))
    numeric, categorical = M.partitioned(base.select(*name.values()), [])
    taught = base.select(*name.values(), F.explode(F.filter(F.array("_random", "_cohort"), lambda t: t)))  # a row for each of the models that learn from it
    placed = M.binned(base, taught, numeric, categorical, ["_set", "_random", "_cohort", "y"], bins)
    counts = materialised(joint.counted(placed, "_set", "_random", "_cohort"))
    kinds = F.array(*(F.struct((2 * F.col("_set") + k).alias("_model"), F.col(train).alias("_train")) for k, train in enumerate(("_random", "_cohort"))))
    both = counts.select("bins", "n", "ones", F.inline(kinds))
    models = joint.fit_boosted_counts(both.where("_train"), "_model", len(name), bins, 2 * n, **options)
    scored = joint.predict_boosted_sets(both.where("not _train"), models, "_model", ["_model", "n", "ones"])
    aucs = R.metrics_by_group(scored.withColumn("p", F.round("p", 12)), "_model", label="ones", count="n").select(F.shiftright("_model", 1).alias("_set"), (F.col("_model") % 2).alias("_k"), "auc")
    out = aucs.join(F.broadcast(names), "_set").groupBy("tier", "seed").agg(*(F.max(F.when(F.col("_k") == k, F.col("auc"))).alias(f"{c}_auc") for k, c in enumerate(("random", "cohort"))))
    return out.withColumn("degradation", F.col("random_auc") - F.col("cohort_auc"))


# -- by bundle


def from_bundles(spark: SparkSession, bundles: Mapping[str, Mapping[int, str]], task: str) -> DataFrame:
    """All splits of a task of bundles (tier -> seed -> folder) as one table: the columns that every bundle has, split, bundle_tier and bundle_seed."""
    parts = [bundle.flat(spark, folder, task).withColumns({"bundle_tier": F.lit(tier), "bundle_seed": F.lit(int(seed)).cast("long")}) for tier, own in bundles.items() for seed, folder in own.items()]
    if not parts:
        raise ValueError("no bundles")
    shared = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
    return reduce(DataFrame.unionByName, (p.select(*shared) for p in parts))


def judged(spark: SparkSession, bundles: Mapping[str, Mapping[int, str]], gates: Gates, *, task: str, key: str, label: str, time: str | None = None, without: Sequence[str] = (), **options) -> tuple[DataFrame, DataFrame]:
    """(report(), failures()) of published bundles, each learnt on its own train split and tested on its test split.

    Features are all shared columns of numbers, booleans and texts but the key, the label, the time and those of ``without``. Shifts of cohorts are those of each tier's lowest seed, by the timestamp ``time``; without one, a gate on them fails as missing.
    Label drifts are told between all three splits. Subsets must name shared columns.
    """
    rows = from_bundles(spark, bundles, task)
    numbers = [f"_h{i}" for i in range(len(M.hashed_id(F.col(key))))]
    rows = materialised(rows.withColumns({n: h for n, h in zip(numbers, M.hashed_id(F.col(key)), strict=True)}))
    kinds = (NumericType, BooleanType, StringType)
    features = [f.name for f in rows.schema.fields if isinstance(f.dataType, kinds) and f.name not in (key, label, "split", "bundle_tier", "bundle_seed", time, *numbers, *without)]
    subsets = {name: own for name, (_, own) in gates.subsets.items()} | ({} if gates.id_only is None else {"id_only": numbers})
    if unknown := {c for own in subsets.values() for c in own} - set(rows.columns):
        raise ValueError(f"not in all bundles: {sorted(unknown)}")
    tests = rows.where(F.col("split").isin("train", "test"))
    found = materialised(metrics(scores(tests, "bundle_tier", "bundle_seed", key, features, label, F.col("split") == "train", subsets=subsets, **options)))
    shifts = drifts = None
    if gates.cohort and time:
        at = F.unix_micros(F.col(time).cast("timestamp"))
        one = rows.join(F.broadcast(rows.groupBy("bundle_tier").agg(F.min("bundle_seed").alias("bundle_seed"))), ["bundle_tier", "bundle_seed"])  # a row a tier
        shifts = materialised(cohort_shifts(one, "bundle_tier", "bundle_seed", key, at, features, label, draw=fast_uniform(42, "cohort", F.col(key)), **options).select("tier", "degradation"))
    elif gates.cohort:
        shifts = found.select("tier").distinct().withColumn("degradation", F.lit(None).cast("double"))
    if gates.drift is not None:
        drifts = label_drifts(rows, "bundle_tier", "bundle_seed", "split", label)
    return report(found, shifts), failures(found, gates, shifts=shifts, drifts=drifts)
