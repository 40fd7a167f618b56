"""Audits of relational tables: keys, windows, reconstruction of labels, overlap of splits, drift."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import quantiles, quantiles_by_group


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Distinct non-null keys of child that parent lacks, with the number of rows of each."""
    keys = child.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("orphan")).agg(F.count("*").alias("n_rows"))
    return keys.join(parent.select(F.col(parent_key).alias("orphan")), "orphan", "left_anti")


def orphan_report(constraints: Sequence[tuple[str, DataFrame, str, str, DataFrame, str]], sample: int = 5) -> DataFrame:
    """(child, parent, n_orphans, n_rows, smallest) for each (name, child, key, name, parent, key); smallest: the ``sample`` smallest orphans."""
    out = []
    for child_name, child, key, parent_name, parent, parent_key in constraints:
        found = orphans(child, key, parent, parent_key)
        few = found.orderBy("orphan").limit(sample).agg(F.concat_ws(",", F.sort_array(F.collect_list("orphan"))).alias("smallest"))
        total = found.agg(F.count("*").alias("n_orphans"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))
        out.append(total.crossJoin(few).select(F.lit(child_name).alias("child"), F.lit(parent_name).alias("parent"), "n_orphans", "n_rows", "smallest"))
    return reduce(DataFrame.unionByName, out)


def marked(df: DataFrame, key: str, others: DataFrame, other_key: str, name: str) -> DataFrame:
    """df with a boolean: whether the key occurs in others."""
    keys = others.select(F.col(other_key).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
    return df.join(keys, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def reconstructed(leads: DataFrame, opportunities: DataFrame, customers: DataFrame, subscriptions: DataFrame, *, won: Column) -> DataFrame:
    """(lead_id, path_opportunity, path_won, path_customer, path_subscription, any_path): which joins give a lead's label away."""
    via = customers.select("customer_id", "opportunity_id").join(opportunities.select("opportunity_id", "lead_id"), "opportunity_id")
    out = leads.select("lead_id")
    out = marked(out, "lead_id", opportunities, "lead_id", "path_opportunity")
    out = marked(out, "lead_id", opportunities.where(won), "lead_id", "path_won")
    out = marked(out, "lead_id", via, "lead_id", "path_customer")
    out = marked(out, "lead_id", via.join(subscriptions.select("customer_id"), "customer_id", "left_semi"), "lead_id", "path_subscription")
    return out.withColumn("any_path", F.col("path_won") | F.col("path_customer") | F.col("path_subscription"))


def window_violations(events: DataFrame, *, key: str, day: Column, window: int) -> DataFrame:
    """(n_rows, n_violations, n_entities): events later than the window, of events with the day since their anchor."""
    late = day > window
    return events.agg(F.count("*").alias("n_rows"), F.count_if(late).alias("n_violations"), F.count_distinct(F.when(late, F.col(key))).alias("n_entities"))


def split_overlap(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(left, right, n_shared): keys that occur in two splits, for every pair of splits that share any."""
    per = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("left"), b.alias("right")))))
    return per.select(F.explode(pairs).alias("p")).groupBy("p.left", "p.right").agg(F.count("*").alias("n_shared"))


def near_duplicate_rows(rows: DataFrame, columns: Sequence[str], decimals: int = 4, split: str = "split") -> DataFrame:
    """split_overlap() of rows by their numbers, rounded half to even: what isn't a number is missing, and rows with none are left out."""
    number = [F.bround(F.col(c).try_cast("double"), decimals) for c in columns]
    # Zero has one sign here, and what is missing is told from what isn't.
    signature = F.concat_ws("|", *(F.coalesce((x + 0.0).cast("string"), F.lit("<null>")) for x in number))
    return split_overlap(rows.where(F.coalesce(*number).isNotNull()).withColumn("_sig", F.sha2(signature, 256)), "_sig", split)


def label_drift(rows: DataFrame, label: str, split: str = "split") -> DataFrame:
    """(left, right, drift): differences of the label's rate between splits; null labels count as false. Those above a tolerance are the caller's to filter."""
    rates = rows.groupBy(split).agg(F.avg(F.coalesce(F.col(label).cast("int"), F.lit(0))).alias("rate"))
    a, b = rates.select(F.col(split).alias("left"), F.col("rate").alias("a")), rates.select(F.col(split).alias("right"), F.col("rate").alias("b"))
    # One row per split on either side.
    return a.join(F.broadcast(b), F.col("left") < F.col("right")).select("left", "right", F.abs(F.col("a") - F.col("b")).alias("drift"))


def differing(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(column, n_differing) of rows of one key, nulls being equal to each other."""
    both = left.alias("l").join(right.alias("r"), key)
    counts = both.agg(*(F.count_if(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))).alias(c) for c in columns))
    return counts.unpivot([], list(columns), "column", "n_differing")


def label_profile(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """(label, n, mean_<c>, median_<c>, ...): what each value of a label goes with. Medians come from counts per value and ranges of them, so no task gets all values of a label."""
    out = df.groupBy(label).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in columns))
    for c in columns:
        medians = quantiles_by_group(df, label, c, {f"median_{c}": 0.5})
        out = out.join(F.broadcast(medians), out[label].eqNullSafe(medians[label]), "left").drop(medians[label])  # a row a label
    return out


def identical_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(signature, columns): the names of the columns that hold the same values in the same rows, sorted and joined by commas; one pass, by sums of the rows' hashes of each column."""
    row = F.xxhash64(*df.columns)
    one = df.agg(*(F.sum(F.xxhash64(row, F.coalesce(F.col(c).cast("string"), F.lit("<null>"))).cast("decimal(38,0)")).cast("string").alias(c) for c in columns))
    return one.unpivot([], list(columns), "column", "signature").groupBy("signature").agg(F.array_join(F.sort_array(F.collect_list("column")), ",").alias("columns"))


def relational_features(leads: DataFrame, opportunities: DataFrame, customers: DataFrame, subscriptions: DataFrame, *, key: str = "lead_id", value: str = "estimated_acv") -> DataFrame:
    """(key, n_opps, max_acv, mean_acv, n_customers, n_subscriptions) of every lead, 0 where it has none: what the tables tell about a lead by joins alone."""
    per = opportunities.groupBy(key).agg(F.count("opportunity_id").alias("n_opps"), F.max(value).alias("max_acv"), F.avg(value).alias("mean_acv"))
    bought = customers.select("customer_id", "opportunity_id").join(opportunities.select("opportunity_id", key), "opportunity_id")
    out = leads.select(key).join(per, key, "left").join(bought.groupBy(key).agg(F.count("*").alias("n_customers")), key, "left")
    out = out.join(subscriptions.select("customer_id").join(bought, "customer_id").groupBy(key).agg(F.count("*").alias("n_subscriptions")), key, "left")
    return out.select(key, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("n_opps", "max_acv", "mean_acv", "n_customers", "n_subscriptions")))


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, null_rate), from one pass."""
    return df.agg(*(F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns)).unpivot([], list(columns), "column", "null_rate")


def repeated_rows(df: DataFrame) -> DataFrame:
    """(n_rows, n_repeats): rows beyond the first of each kind."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("_n")).agg(F.sum("_n").alias("n_rows"), (F.sum("_n") - F.count("*")).alias("n_repeats"))


def value_stats(df: DataFrame, column: str) -> DataFrame:
    """(min, mean, median, p95, p99, max, share_at_max), one row; quantiles are exact."""
    c = F.col(column)
    top = df.agg(F.max(c).alias("top"))
    at_top = df.crossJoin(F.broadcast(top)).agg(F.avg((c == F.col("top")).cast("int")).alias("share_at_max"))  # top: one row
    stats = df.agg(F.min(c).alias("min"), F.avg(c).alias("mean"), F.max(c).alias("max"))
    return stats.crossJoin(quantiles(df, column, {"median": 0.5, "p95": 0.95, "p99": 0.99})).crossJoin(at_top).select("min", "mean", "median", "p95", "p99", "max", "share_at_max")


def group_rates(df: DataFrame, group: str, label: Column, least: int = 0) -> DataFrame:
    """(group, n, share, rate) of groups of at least ``least`` rows; a null group is a group."""
    per = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(label).alias("rate"))
    total = df.agg(F.count("*").alias("all"))
    return per.crossJoin(F.broadcast(total)).where(F.col("n") >= least).select(group, "n", (F.col("n") / F.col("all")).alias("share"), "rate")


def channel_audits(df: DataFrame, columns: Sequence[str], label: str, train: Column, tier: str) -> DataFrame:
    """(tier, column, n_values, n_train, n_test, train_rate, test_rate, spread, auc_train, auc_test) of every category column in every tier, from one scan and one aggregation by value.

    A value's score is its label's rate in training; values that only the test has get the tier's training rate. spread: the highest rate less the lowest. AUCs are one half with fewer than two values in training or with one class only.
    Null is a value; null labels count as 0. The values of a column, not its rows, are ordered in one task.
    """
    y, taught = F.coalesce(F.col(label).cast("int"), F.lit(0)), F.coalesce(train, F.lit(False))
    long = df.select(F.col(tier).alias("tier"), y.alias("_y"), taught.alias("_t"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("_v"))
    per = long.groupBy("tier", F.col("_v.column").alias("column"), F.col("_v.value").alias("value")).agg(*(F.sum(F.when(s, c).otherwise(0)).alias(n) for n, s, c in (("a", F.col("_t"), F.lit(1)), ("p", F.col("_t"), F.col("_y")), ("b", ~F.col("_t"), F.lit(1)), ("q", ~F.col("_t"), F.col("_y")))))
    whole = Window.partitionBy("tier", "column")
    base = F.try_divide(F.sum("p").over(whole), F.sum("a").over(whole))
    rated = per.withColumn("rate", F.try_divide(F.col("p"), F.col("a"))).withColumn("score", F.coalesce("rate", base))
    # Values of one score are one step of the curve.
    steps = rated.groupBy("tier", "column", "score").agg(*(F.sum(c).alias(c) for c in "apbq"), F.count_if(F.col("a") > 0).alias("k"), F.min("rate").alias("low"), F.max("rate").alias("high"))
    above = Window.partitionBy("tier", "column").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumns({f"{c}_above": F.coalesce(F.sum(c).over(above), F.lit(0)) for c in "pq"})
    out = steps.groupBy("tier", "column").agg(
        F.sum("k").alias("n_values"), *(F.sum(c).alias(c) for c in "apbq"), (F.max("high") - F.min("low")).alias("spread"),
        F.sum((F.col("a") - F.col("p")) * (F.col("p_above") + F.col("p") / 2)).alias("won_train"), F.sum((F.col("b") - F.col("q")) * (F.col("q_above") + F.col("q") / 2)).alias("won_test"),
    )
    auc = lambda won, n, p: F.when(F.col("n_values") < 2, 0.5).otherwise(F.coalesce(F.try_divide(F.col(won), F.col(p) * (F.col(n) - F.col(p))), F.lit(0.5)))
    rate = lambda p, n: F.coalesce(F.try_divide(F.col(p), F.col(n)), F.lit(0.0))
    return out.select("tier", "column", "n_values", F.col("a").alias("n_train"), F.col("b").alias("n_test"), rate("p", "a").alias("train_rate"), rate("q", "b").alias("test_rate"), F.coalesce("spread", F.lit(0.0)).alias("spread"), auc("won_train", "a", "p").alias("auc_train"), auc("won_test", "b", "q").alias("auc_test"))


def spread(rates: DataFrame) -> DataFrame:
    return rates.agg(F.count("*").alias("n_groups"), F.min("rate").alias("lowest"), F.max("rate").alias("highest"), (F.max("rate") - F.min("rate")).alias("spread"))


def target_encoding(rows: DataFrame, train: Column, group: str, label: Column) -> DataFrame:
    """rows with ``encoded``: the label's mean over the training rows of the group, else over all training rows."""
    taught = rows.where(train)
    per, overall = taught.groupBy(group).agg(F.avg(label).alias("_m")), taught.agg(F.avg(label).alias("_o"))
    return rows.join(per, group, "left").crossJoin(F.broadcast(overall)).withColumn("encoded", F.coalesce("_m", "_o")).drop("_m", "_o")


def gate_failures(metrics: DataFrame, bands: DataFrame) -> DataFrame:
    """Metrics (tier, metric, value) outside their bands (tier, metric, low, high); a missing value fails, a null bound doesn't bind."""
    both = bands.join(metrics, ["tier", "metric"], "left")
    bad = F.col("value").isNull() | F.coalesce(F.col("value") < F.col("low"), F.lit(False)) | F.coalesce(F.col("value") > F.col("high"), F.lit(False))
    return both.where(bad).select("tier", "metric", "value", "low", "high")


def banned(names: Sequence[str], banned_names: Sequence[str]) -> list[str]:
    """Which of the names must not be there."""
    return sorted(set(names) & set(banned_names))
