"""Quality of published datasets: panels of metrics by tier and seed, their medians and order, shifts between cohorts, probes for leakage and checks of flat datasets."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialised
from . import audit
from . import models as M
from . import ranking as R

#: The order of difficulty, easiest first.
TIERS = ("intro", "intermediate", "advanced")


def panel(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: str, *, k: int = 100) -> DataFrame:
    """(metric, value): both models' AUC and average precision and, for the linear one, losses, calibration, precision at ``k`` and the top decile's rate, on test."""
    scored = {kind: materialised(M.fit_predict(train, test, features, label, kind, [key])) for kind in ("lr", "gbt")}
    ordered = R.ranked(scored["lr"], F.col("p"), [key], descending=True, total="n")
    parts = [test.agg(F.avg(F.col(label).cast("double")).alias("rate_test"))]
    for kind, rows in scored.items():
        parts += [R.roc_auc(rows).select(F.col("auc").alias(f"{kind}_auc")), R.average_precision(rows).select(F.col("average_precision").alias(f"{kind}_average_precision"))]
    parts += [R.losses(scored["lr"]), R.calibration(scored["lr"], 10).agg(F.max("error").alias("calibration_max_error")), R.at_k(ordered, [k]).select(F.col("precision").alias(f"precision_at_{k}")), R.at_percent(ordered, [10]).select(F.col("rate").alias("top_decile_rate"))]
    one = reduce(DataFrame.crossJoin, parts).withColumn("gbt_minus_lr_auc", F.col("gbt_auc") - F.col("lr_auc"))  # one row each
    return one.unpivot([], one.columns, "metric", "value")


def across_seeds(metrics: DataFrame) -> DataFrame:
    """(tier, metric, n_seeds, median, spread) of (tier, seed, metric, value); spread: the highest less the lowest. Missing values count for nothing."""
    return metrics.where(F.col("value").isNotNull()).groupBy("tier", "metric").agg(F.count("*").alias("n_seeds"), F.percentile("value", 0.5).alias("median"), (F.max("value") - F.min("value")).alias("spread"))


def tier_order(medians: DataFrame, tiers: Sequence[str] = TIERS) -> DataFrame:
    """(metric, tier, median, place, above_next) of (tier, metric, median): each tier's place by falling median, and whether it lies above the next harder tier; null where that is missing."""
    hard = F.array_position(F.array(*map(F.lit, tiers)), F.col("tier"))
    rows = medians.where(F.col("tier").isin(*tiers)).withColumn("_hard", hard)
    place = F.rank().over(Window.partitionBy("metric").orderBy(F.desc_nulls_last("median"))).cast("long")
    after = F.lead(F.struct("median", "_hard")).over(Window.partitionBy("metric").orderBy("_hard"))  # one row per tier
    above = F.when(after["_hard"] == F.col("_hard") + 1, F.col("median") > after["median"])
    return rows.select("metric", "tier", "median", place.alias("place"), above.alias("above_next"))


def out_of_range(rates: DataFrame, ranges: DataFrame, tolerance: float) -> DataFrame:
    """(tier, rate, low, high) of (tier, rate) outside of the tier's range (tier, low, high) by more than the tolerance."""
    return rates.join(F.broadcast(ranges), "tier").where((F.col("rate") < F.col("low") - tolerance) | (F.col("rate") > F.col("high") + tolerance)).select("tier", "rate", "low", "high")


def cohort_shift(rows: DataFrame, key: str, time: Column, features: Sequence[str], label: str, *, early: float = 0.85, test_share: float = 0.15, seed: int = 42, kind: str = "gbt") -> DataFrame:
    """(random_auc, cohort_auc, degradation): a model that is tested on rows picked at random, and one learnt on the earliest ``early`` share and tested on the rest."""
    ordered = materialised(R.ranked(rows, time, [key], total="_n")).withColumn("_early", F.col("rn") <= F.bround(F.col("_n") * early)).drop("rn", "_n")
    pairs = {"random_auc": M.held_out(rows, key, test_share, seed, label), "cohort_auc": (ordered.where("_early"), ordered.where("not _early"))}
    aucs = [R.roc_auc(M.fit_predict(train, test, features, label, kind)).select(F.col("auc").alias(name)) for name, (train, test) in pairs.items()]
    return aucs[0].crossJoin(aucs[1]).withColumn("degradation", F.col("random_auc") - F.col("cohort_auc"))  # one row each


def train_rate_auc(rows: DataFrame, group: str, label: str, train: Column) -> DataFrame:
    """(in_sample, out_of_sample): how well a group's rate among the training rows orders those rows and the others."""
    coded = audit.target_encoding(rows.withColumn("_train", train), F.col("_train"), group, F.col(label)).select(F.col("encoded").alias("p"), F.col(label).alias("y"), "_train")
    a, b = (R.roc_auc(coded.where(c)).select(F.col("auc").alias(name)) for c, name in ((F.col("_train"), "in_sample"), (~F.col("_train"), "out_of_sample")))
    return a.crossJoin(b)  # one row each


# -- probes

FINDING = ("probe", "detail", "n")


def _finding(probe: str, detail: Column, n: Column) -> list[Column]:
    return [F.lit(probe).alias("probe"), detail.cast("string").alias("detail"), n.cast("long").alias("n")]


def banned_columns(tables: Mapping[str, DataFrame], banned: Mapping[str, Sequence[str]]) -> DataFrame:
    """Columns that tell the outcome, by their names."""
    found = [("banned_column", f"{t}.{c}", 1) for t, columns in banned.items() if t in tables for c in audit.banned(tables[t].columns, columns)]
    return next(iter(tables.values())).sparkSession.createDataFrame(found, "probe string, detail string, n long")


def open_paths(tables: Mapping[str, DataFrame], won: Column) -> DataFrame:
    """Joins that give leads' labels away: paths that any lead has and that must be empty."""
    paths = audit.reconstructed(tables["leads"], tables["opportunities"], tables["customers"], tables["subscriptions"], won=won)
    names = ["path_won", "path_customer", "path_subscription"]
    return paths.agg(*(F.count_if(F.col(c)).alias(c) for c in names)).unpivot([], names, "path", "n").where("n > 0").select(*_finding("reconstruction", F.col("path"), F.col("n")))


def missing_parents(constraints: Sequence[tuple[str, DataFrame, str, str, DataFrame, str]]) -> DataFrame:
    """Keys without a parent, for each (child, df, key, parent, df, key)."""
    made = [audit.orphans(child, key, parent, parent_key).agg(F.count("*").alias("n")).where("n > 0").select(*_finding("orphans", F.lit(f"{name}.{key} -> {parent_name}"), F.col("n"))) for name, child, key, parent_name, parent, parent_key in constraints]
    return reduce(DataFrame.unionByName, made)


def late_events(events: Mapping[str, tuple[DataFrame, str, Column]], window: int) -> DataFrame:
    """Events behind the window, for each name -> (df, key, day since the anchor)."""
    made = [audit.window_violations(df, key=key, day=day, window=window).where("n_violations > 0").select(*_finding("late_events", F.lit(name), F.col("n_violations"))) for name, (df, key, day) in events.items()]
    return reduce(DataFrame.unionByName, made)


def split_leaks(rows: DataFrame, *, key: str, label: str, columns: Sequence[str], drift: float, decimals: int = 4) -> DataFrame:
    """Keys and rounded rows that several splits have, and label rates that differ by more than ``drift``, in thousandths."""
    pair = F.concat_ws(" ", "left", "right")
    own = audit.split_overlap(rows, key).select(*_finding("split_overlap", pair, F.col("n_shared")))
    near = audit.near_duplicate_rows(rows, columns, decimals).select(*_finding("near_duplicates", pair, F.col("n_shared")))
    drifted = audit.label_drift(rows, label).where(F.col("drift") > drift).select(*_finding("label_drift", pair, F.floor(F.col("drift") * 1000)))
    return own.unionByName(near).unionByName(drifted)


def learnable(scored: DataFrame, probe: str, most: float) -> DataFrame:
    """A model's AUC in thousandths, where it lies above ``most``."""
    return R.roc_auc(scored).where(F.col("auc") > most).select(*_finding(probe, F.lit(f"auc above {most}"), F.floor(F.col("auc") * 1000)))


def findings(probes: Mapping[str, Callable[[], DataFrame]], only: Sequence[str] | None = None) -> DataFrame:
    """(probe, detail, n) of all probes, or those of the names ``only``; an unknown name raises."""
    if only is not None and (unknown := set(only) - set(probes)):
        raise ValueError(f"no probes {sorted(unknown)}; there are {sorted(probes)}")
    return reduce(DataFrame.unionByName, (make().select(*FINDING) for name, make in probes.items() if only is None or name in only))


# -- flat datasets


def flat_checks(df: DataFrame, *, columns: Sequence[str], label: str, value: str, groups: Sequence[str], missing: float = 0.10, rate: tuple[float, float] = (0.15, 0.40), values: tuple[float, float] = (1_000.0, 500_000.0), least: int = 20) -> DataFrame:
    """(check, passed, found) of a flat dataset: its columns, repeated rows, missing cells, a binary label with both classes and a rate in range, values in range, and no group of ``least`` rows with one label only.

    found: how many columns, rows, cells or groups break the rule, or the rate. An empty dataset has no classes and no rate, and fails.
    """
    spark = df.sparkSession
    gone, extra = sorted(set(columns) - set(df.columns)), sorted(set(df.columns) - set(columns))
    out = [spark.createDataFrame([("columns", not (gone or extra), float(len(gone) + len(extra)))], "check string, passed boolean, found double")]
    check = lambda name, passed, found: F.struct(F.lit(name).alias("check"), passed.alias("passed"), found.cast("double").alias("found"))
    exploded = lambda one, rows: one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    y = F.col(label).cast("double")
    one = df.agg(F.count("*").alias("n"), F.count_if(y.isNull()).alias("no_label"), F.count_if(~y.isin(0.0, 1.0)).alias("odd"), F.count_distinct(y).alias("classes"), F.avg(y).alias("rate"), F.count_if((F.col(value) < values[0]) | (F.col(value) > values[1])).alias("off"))
    rows = [check("label_complete", F.col("no_label") == 0, F.col("no_label")), check("label_binary", F.col("odd") == 0, F.col("odd")), check("label_both_classes", F.col("classes") == 2, F.col("classes")), check("rate", F.coalesce(F.col("rate").between(*rate), F.lit(False)), F.col("rate")), check("values", F.col("off") == 0, F.col("off"))]
    out.append(exploded(one, rows))
    out.append(exploded(audit.repeated_rows(df), [check("repeated_rows", F.coalesce("n_repeats", F.lit(0)) == 0, F.coalesce("n_repeats", F.lit(0)))]))
    out.append(exploded(audit.null_rates(df, [c for c in df.columns if c != label]).agg(F.count_if(F.col("null_rate") > missing).alias("n")), [check("missing_cells", F.col("n") == 0, F.col("n"))]))
    for g in groups:
        pure = audit.group_rates(df, g, y, least).agg(F.count_if(F.col("rate").isin(0.0, 1.0)).alias("n"))
        out.append(exploded(pure, [check(f"group_{g}", F.col("n") == 0, F.col("n"))]))
    return reduce(DataFrame.unionByName, out)


def flat_validation(df: DataFrame, *, key: str, columns: Sequence[str], label: str, value: str, groups: Sequence[str], auc: tuple[float, float] = (0.62, 0.90), traps: Sequence[str] | str = "leakage_", trap_mean: float = 0.03, trap_least: float = 0.015, seeds: Sequence[int] = tuple(range(42, 52)), share: float = 0.3, **options) -> DataFrame:
    """flat_checks() and, where each label is 0 or 1 and both occur, baseline_auc (the linear model's mean over the seeds' hold-outs lies within ``auc``) and leakage_trap:<column> (found: the mean gain).

    traps: columns that leak, or what their names begin with. A trap must add ``trap_mean`` on average and ``trap_least`` with every seed; none of them is a feature of the baseline. Features are ``columns`` without label, key and traps.
    All models are fitted in the passes of one. options: of flat_checks().
    """
    first = materialised(flat_checks(df, columns=columns, label=label, value=value, groups=groups, **options))  # a row a check
    leaks = [c for c in df.columns if c.startswith(traps)] if isinstance(traps, str) else list(traps)
    features = [c for c in columns if c in df.columns and c not in (label, key, *leaks)]
    if not features or first.where(F.col("check").isin("label_complete", "label_binary", "label_both_classes") & ~F.col("passed")).count():
        return first
    panel = materialised(M.trap_panel(df, key, features, leaks, label, seeds, share))
    base = panel.where(F.col("trap").isNull()).agg(F.avg("auc").alias("found")).select(F.lit("baseline_auc").alias("check"), F.coalesce(F.col("found").between(*auc), F.lit(False)).alias("passed"), "found")
    gains = M.trap_deltas(panel).groupBy("trap").agg(F.avg("delta").alias("found"), F.min("delta").alias("_least"), F.count("delta").alias("_n"))
    enough = (F.col("found") >= trap_mean) & (F.col("_least") >= trap_least) & (F.col("_n") == len(seeds))
    return first.unionByName(base).unionByName(gains.select(F.concat(F.lit("leakage_trap:"), "trap").alias("check"), F.coalesce(enough, F.lit(False)).alias("passed"), "found"))
