"""Ranks over whole tables, and metrics of scored rows.

A global order is made without a single task: rows are dealt into ranges of the keys by quantiles, ranked within each range, and each range gets the
number of rows before it. The ranges and their sizes are a few hundred rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialised

#: Rows that are looked at for each range to choose where ranges end.
LOOKED_AT = 32


def _ranges(df: DataFrame, key: str, ties: Sequence[Column | str] = (), parts: int | None = None) -> DataFrame:
    """df with _range, which grows with the double column ``key``. Null keys come last.

    Ranges end at quantiles of a bounded sample, the rows of the lowest hashes; rows of equal keys share a range, unless the sample shows that one key has several ranges' worth of rows: it is then
    cut into ranges by ``ties``. Another sample gives other ranges, never another order.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n <= 1:
        return df.withColumn("_range", F.lit(0.0))
    keyed = df.withColumns({"_nan": F.coalesce(F.col(key), F.lit(math.nan)), "_tie": F.struct(F.col(key).isNull().alias("last"), *ties)})  # what is not a number has a range of its own, the last
    looked = keyed.select("_nan", "_tie").orderBy(F.xxhash64("_nan", "_tie")).limit(n * LOOKED_AT)
    at = F.row_number().over(Window.orderBy("_nan", "_tie"))  # of at most n * LOOKED_AT rows
    cuts = looked.withColumns({"_at": at, "_of": F.count("*").over(Window.partitionBy())}).where(F.col("_at") % F.ceil(F.col("_of") / n) == 0).groupBy("_nan").agg(F.sort_array(F.collect_list("_tie")).alias("_inner"))
    found = sorted(r["_nan"] for r in cuts.select("_nan").collect() if math.isfinite(r["_nan"]))
    splits = [-math.inf, *(found or [0.0]), math.inf]
    out = Bucketizer(splits=splits, inputCol="_nan", outputCol="_bucket", handleInvalid="keep").transform(keyed)
    # A bucket begins at one of the cuts; its rows of that very key come first.
    inside = F.lit(n + 1)
    if ties:
        out = out.join(F.broadcast(cuts.where(F.size("_inner") > 1)), "_nan", "left")
        inside = F.when(F.col("_inner").isNull(), inside).otherwise(F.size(F.filter("_inner", lambda x: x <= F.col("_tie"))))
    return out.withColumn("_range", F.col("_bucket") * (n + 2) + inside).drop("_nan", "_tie", "_bucket", "_inner")


def _ordered(key: Column, descending: bool) -> Column:
    """The key as a double that grows in the wanted order. Adding zero makes negative zeros positive, which bins keep apart and sorts don't."""
    return (-key if descending else key).cast("double") + F.lit(0.0)


def ranked(df: DataFrame, key: Column, ties: Sequence[Column | str], *, descending: bool = False, rank: str = "rn", total: str | None = None) -> DataFrame:
    """df with ``rank``: 1, 2, ... in the order of the numeric ``key`` and then ``ties``; null keys last. ``total``: also the number of rows."""
    keyed = _ranges(df.withColumn("_key", _ordered(key, descending)), "_key", ties)
    sizes = keyed.groupBy("_range").agg(F.count("*").alias("_size"))
    # One row per range, so the window below is over a few hundred rows.
    before = sizes.withColumns({"_before": F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_total": F.sum("_size").over(Window.partitionBy())}).drop("_size")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("_key").asc_nulls_last(), *ties))
    out = keyed.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(rank, (F.col("_own") + F.col("_before")).cast("long"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_range", "_key", "_own", "_before", "_total")


def running(df: DataFrame, key: str, sums: Sequence[str], *, descending: bool = False) -> DataFrame:
    """df with cum_<name> and all_<name> for each of ``sums``: totals up to and with each row in the order of a numeric column of distinct values, and over all."""
    keyed = _ranges(df.withColumn("_key", _ordered(F.col(key), descending)), "_key")
    parts = keyed.groupBy("_range").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    until = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_range", *(F.coalesce(F.sum(f"_{c}").over(until), F.lit(0)).alias(f"_b_{c}") for c in sums), *(F.sum(f"_{c}").over(Window.partitionBy()).alias(f"all_{c}") for c in sums))
    inside = Window.partitionBy("_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.join(F.broadcast(parts), "_range").withColumns({f"cum_{c}": F.sum(c).over(inside) + F.col(f"_b_{c}") for c in sums})
    return out.drop("_range", "_key", *(f"_b_{c}" for c in sums))


def quantiles(df: DataFrame, column: str, at: Mapping[str, float]) -> DataFrame:
    """One row: exact quantiles of a numeric column under the names of ``at``, linear between neighbours; null without values. Values are counted first, and no task gets all of them."""
    per = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("n"))
    cum = running(per, "_v", ["n"])
    place = {name: q * (F.col("all_n") - 1) for name, q in at.items()}
    ends = [F.min(F.when(F.col("cum_n") > f(x), F.col("_v"))).alias(f"_{side}_{name}") for name, x in place.items() for side, f in (("lo", F.floor), ("hi", F.ceil))]
    one = cum.agg(*ends, F.max("all_n").alias("all_n"))
    return one.select(*((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (x - F.floor(x))).alias(name) for name, x in place.items()))


def quantiles_by_group(df: DataFrame, group: str, column: str, at: Mapping[str, float]) -> DataFrame:
    """(group, the names of ``at``): quantiles() of every group that has values, all groups in one order. Values are counted first, and ranges of (group, value) are dealt, so no task gets a group's values; a null group is a group."""
    per = df.where(F.col(column).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialised(materialised(per).repartitionByRange(parts, "_g", "_v").withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_g", "_part").agg(F.sum("_n").alias("_size"))  # a row for each range and group that meet
    whole = Window.partitionBy("_g")
    sizes = sizes.select(F.col("_g").alias("_of_group"), F.col("_part").alias("_of_part"), (F.sum("_size").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")).alias("_before"), F.sum("_size").over(whole).alias("_all"))
    inside = F.sum("_n").over(Window.partitionBy("_g", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    rows = dealt.withColumn("_inside", inside).join(sizes, F.col("_g").eqNullSafe(F.col("_of_group")) & (F.col("_part") == F.col("_of_part"))).withColumn("_until", F.col("_inside") + F.col("_before"))
    place = {name: q * (F.col("_all") - 1) for name, q in at.items()}
    ends = [F.min(F.when(F.col("_until") > f(x), F.col("_v"))).alias(f"_{side}_{name}") for name, x in place.items() for side, f in (("lo", F.floor), ("hi", F.ceil))]
    one = rows.groupBy("_g").agg(*ends, F.max("_all").alias("_all"))
    return one.select(F.col("_g").alias(group), *((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (x - F.floor(x))).alias(name) for name, x in place.items()))


def at_k(scored: DataFrame, ks: Sequence[int], label: str = "y") -> DataFrame:
    """(k, precision, recall) of rows with rn and n; null where k is not within 1 to n."""
    top = scored.agg(*(F.sum(F.when(F.col("rn") <= k, F.col(label))).alias(f"h{k}") for k in ks), F.sum(label).alias("all"), F.count("*").alias("n"))
    valid = {k: F.lit(k > 0) & (F.lit(k) <= F.col("n")) for k in ks}
    rows = [F.struct(F.lit(k).alias("k"), F.when(valid[k], F.try_divide(F.col(f"h{k}"), F.lit(k))).alias("precision"), F.when(valid[k], F.try_divide(F.col(f"h{k}"), F.col("all"))).alias("recall")) for k in ks]
    return top.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def cutoff_rank(n: Column, percent: float) -> Column:
    """The number of rows in the top ``percent``: at least one, halves to even."""
    return F.greatest(F.lit(1), F.bround(n * percent / 100)).cast("long")


def at_percent(scored: DataFrame, percents: Sequence[float], label: str = "y", value: str | None = None) -> DataFrame:
    """(percent, k, rate, lift, gain[, capture]) of rows with rn and n, from one pass over them."""
    top = {p: F.col("rn") <= cutoff_rank(F.col("n"), p) for p in percents}
    made = [F.sum(F.when(c, F.col(label)).otherwise(0)).alias(f"h{i}") for i, c in enumerate(top.values())]
    if value:
        made += [F.sum(F.when(c, F.col(label) * F.col(value)).otherwise(0.0)).alias(f"v{i}") for i, c in enumerate(top.values())] + [F.sum(F.col(label) * F.col(value)).alias("value")]
    one = scored.agg(*made, F.sum(label).alias("all"), F.count("*").alias("n"))
    rows = []
    for i, p in enumerate(percents):
        k = cutoff_rank(F.col("n"), p)
        rate = F.try_divide(F.col(f"h{i}"), k)
        fields = [F.lit(float(p)).alias("percent"), k.alias("k"), rate.alias("rate"), F.try_divide(rate, F.try_divide(F.col("all"), F.col("n"))).alias("lift"), F.try_divide(F.col(f"h{i}"), F.col("all")).alias("gain")]
        if value:
            fields.append(F.try_divide(F.col(f"v{i}"), F.col("value")).alias("capture"))
        rows.append(F.struct(*fields))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def capture_curve(scored: DataFrame, orders: Mapping[str, Column], ties: Sequence[str], *, points: int = 100, label: str = "y", value: str = "value") -> DataFrame:
    """(percent, capture_<name>, ...): the share of all positives' value that the first ``percent`` of the rows in each falling order hold, at ``points`` steps."""
    out = None
    for name, by in orders.items():
        rows = ranked(scored, by, ties, descending=True, total="_n")
        # A row counts from the first step that reaches its rank.
        step = F.ceil(F.col("rn") * points / F.col("_n")).cast("long")
        gained = rows.groupBy(step.alias("_step")).agg(F.sum(F.col(label) * F.col(value)).alias("_gain"))
        until = Window.orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)  # of ``points`` rows
        curve = gained.select((F.col("_step") * 100.0 / points).alias("percent"), F.try_divide(F.sum("_gain").over(until), F.sum("_gain").over(Window.partitionBy())).alias(f"capture_{name}"))
        out = curve if out is None else out.join(curve, "percent", "full")
    return out


def calibration(scored: DataFrame, bins: int, score: str = "p", label: str = "y") -> DataFrame:
    """(bin, n, mean_score, rate, error) of equal-width bins over 0 to 1, the last one closed; empty bins are left out."""
    at = F.least(F.lit(bins - 1), F.floor(F.col(score) * bins)).cast("int")
    out = scored.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(label).alias("rate"))
    return out.withColumn("error", F.abs(F.col("mean_score") - F.col("rate")))


def thresholds(scored: DataFrame, at: Sequence[float], score: str = "p", label: str = "y") -> DataFrame:
    """(threshold, n, precision, recall) of the rows above each threshold."""
    made = []
    for i, t in enumerate(at):
        above = F.col(score) >= t
        made += [F.count_if(above).alias(f"n{i}"), F.sum(F.when(above, F.col(label)).otherwise(0)).alias(f"h{i}")]
    one = scored.agg(*made, F.sum(label).alias("all"))
    rows = [F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("n"), F.try_divide(F.col(f"h{i}"), F.col(f"n{i}")).alias("precision"), F.try_divide(F.col(f"h{i}"), F.col("all")).alias("recall")) for i, t in enumerate(at)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def by_score(scored: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """(score, pos, neg, cum_pos, cum_neg, all_pos, all_neg): one row per distinct score, highest first in the sums."""
    per = scored.groupBy(score).agg(F.sum(label).cast("double").alias("pos"), F.sum(1 - F.col(label)).cast("double").alias("neg"))
    return running(per, score, ["pos", "neg"], descending=True)


def roc_auc(scored: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """(auc): the share of pairs of a positive and a negative row in the right order, ties counting half; null with one class only."""
    rows = by_score(scored, score, label)
    right = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2))
    return rows.agg(F.try_divide(right, F.max("all_pos") * F.max("all_neg")).alias("auc"))


def average_precision(scored: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """(average_precision): the sum over distinct scores of the step in recall times the precision there."""
    rows = by_score(scored, score, label)
    return rows.agg(F.sum(F.try_divide(F.col("pos"), F.col("all_pos")) * F.try_divide(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))).alias("average_precision"))


def metrics_by_group(scored: DataFrame, group: str, score: str = "p", label: str = "y", count: str | None = None) -> DataFrame:
    """(group, n_pos, n_neg, auc, average_precision) of scored rows (group, score, label), all groups in one order; null with one class only. count: how many rows each one stands for, ``label`` being the sum of theirs.

    Distinct scores are counted first. They are dealt by ranges of (group, score), and each range gets its group's sums above it, so neither a group nor the groups together are ordered in one task.
    """
    per = scored.groupBy(F.col(group).alias("_g"), F.col(score).alias("_s")).agg(F.sum(label).cast("double").alias("_pos"), F.sum((F.col(count) if count else F.lit(1)) - F.col(label)).cast("double").alias("_neg"))
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialised(materialised(per).repartitionByRange(parts, "_g", F.desc("_s")).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_g", "_part").agg(F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))  # a row for each range and group that meet
    until = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_g")
    sums = sums.select("_g", "_part", *(F.coalesce(F.sum(c).over(until), F.lit(0.0)).alias(f"{c}_above") for c in ("_p", "_n")), *(F.sum(c).over(whole).alias(f"{c}_all") for c in ("_p", "_n")))
    inside = Window.partitionBy("_g", "_part").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.join(sums, ["_g", "_part"]).withColumns({"_cp": F.sum("_pos").over(inside) + F.col("_p_above"), "_cn": F.sum("_neg").over(inside) + F.col("_n_above")})
    right = F.sum(F.col("_neg") * (F.col("_cp") - F.col("_pos") / 2))
    precision = F.sum(F.try_divide(F.col("_pos"), F.col("_p_all")) * F.try_divide(F.col("_cp"), F.col("_cp") + F.col("_cn")))
    return rows.groupBy(F.col("_g").alias(group)).agg(F.max("_p_all").cast("long").alias("n_pos"), F.max("_n_all").cast("long").alias("n_neg"), F.try_divide(right, F.max("_p_all") * F.max("_n_all")).alias("auc"), precision.alias("average_precision"))


def ranked_in_groups(df: DataFrame, group: str, score: str, ties: Sequence[str]) -> DataFrame:
    """df, written, with rn (1, 2, ... by falling score and then ``ties`` within each group, null scores last) and n, the group's rows. Rows are dealt by ranges of (group, score, ties), so no group is ordered in one task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    falling = F.col(score).desc_nulls_last()
    dealt = materialised(df.repartitionByRange(parts, group, falling, *ties).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy(group, "_part").agg(F.count("*").alias("_size"))  # a row for each range and group that meet
    whole = Window.partitionBy(group)
    sizes = sizes.select(F.col(group).alias("_of_group"), F.col("_part").alias("_of_part"), (F.sum("_size").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")).alias("_before"), F.sum("_size").over(whole).alias("n"))
    own = F.row_number().over(Window.partitionBy(group, "_part").orderBy(falling, *ties))
    out = dealt.withColumn("_own", own).join(sizes, F.col(group).eqNullSafe(F.col("_of_group")) & (F.col("_part") == F.col("_of_part")))
    return out.withColumn("rn", (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_own", "_of_group", "_of_part", "_before")


def panel_by_group(scored: DataFrame, group: str, ties: Sequence[str], *, ks: Sequence[int] = (50, 100), percents: Sequence[float] = (1, 5, 10), bins: int = 10, score: str = "p", label: str = "y") -> DataFrame:
    """(group, metric, value) of scored rows: n, rate, auc, average_precision, brier, log_loss, calibration_max_error, precision_at_<k>, recall_at_<k>, lift_at_<percent> and top_decile_rate of every group.

    All groups are ordered together and summed in one aggregation. Values that are undefined (one class only, k beyond the group's rows) are null. Scores and labels must not be null.
    """
    rows = ranked_in_groups(scored.select(F.col(group).alias("_g"), *(F.col(c).alias(f"_t{i}") for i, c in enumerate(ties)), F.col(score).alias("_s"), F.col(label).alias("_y")), "_g", "_s", [f"_t{i}" for i in range(len(ties))])
    kept = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("_s")))
    y = F.col("_y")
    tops = sorted({*percents, 10})
    sums = {"_square": (F.col("_s") - y) * (F.col("_s") - y), "_log": -(y * F.log(kept) + (1 - y) * F.log(1 - kept))}
    sums |= {f"_k{k}": F.when(F.col("rn") <= k, y) for k in ks} | {f"_c{i}": F.when(F.col("rn") <= cutoff_rank(F.col("n"), p), y) for i, p in enumerate(tops)}
    at = F.least(F.lit(bins - 1), F.floor(F.col("_s") * bins))
    per = rows.groupBy("_g", at.alias("_bin")).agg(F.count("*").alias("_n"), F.sum(y).alias("_pos"), F.sum("_s").alias("_p"), *(F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in sums.items()))
    one = per.groupBy("_g").agg(F.sum("_n").alias("n"), F.sum("_pos").alias("pos"), F.max(F.abs(F.col("_p") - F.col("_pos")) / F.col("_n")).alias("calibration_max_error"), *(F.sum(name).alias(name) for name in sums))
    rate = F.col("pos") / F.col("n")
    values = {"n": F.col("n"), "rate": rate, "brier": F.col("_square") / F.col("n"), "log_loss": F.col("_log") / F.col("n"), "calibration_max_error": F.col("calibration_max_error")}
    for k in ks:
        inside = F.lit(k > 0) & (F.lit(k) <= F.col("n"))
        values |= {f"precision_at_{k}": F.when(inside, F.col(f"_k{k}") / k), f"recall_at_{k}": F.when(inside, F.try_divide(F.col(f"_k{k}"), F.col("pos")))}
    for i, p in enumerate(tops):
        top = F.col(f"_c{i}") / cutoff_rank(F.col("n"), p)
        values |= {f"lift_at_{p:g}": F.try_divide(top, rate)} if p in percents else {}
        values |= {"top_decile_rate": top} if p == 10 else {}
    ordered = metrics_by_group(rows.select("_g", "_s", "_y"), "_g", "_s", "_y").select(F.col("_g").alias("_h"), "auc", "average_precision")
    both = one.join(ordered, F.col("_g").eqNullSafe(F.col("_h")), "left")  # a row a group on either side
    wide = both.select("_g", *(c.cast("double").alias(name) for name, c in values.items()), "auc", "average_precision")
    return wide.unpivot(["_g"], [c for c in wide.columns if c != "_g"], "metric", "value").withColumnRenamed("_g", group)


def losses(scored: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """(brier, log_loss); probabilities are kept 1e-15 off 0 and 1."""
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(score)))
    y = F.col(label)
    return scored.agg(F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def confusion(scored: DataFrame, predicted: Column, label: str = "y") -> DataFrame:
    """(tp, fp, fn, tn, accuracy, precision, recall, f1); null where a share is undefined."""
    y = F.col(label) == 1
    c = scored.agg(F.count_if(predicted & y).alias("tp"), F.count_if(predicted & ~y).alias("fp"), F.count_if(~predicted & y).alias("fn"), F.count_if(~predicted & ~y).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"))
