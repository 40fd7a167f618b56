"""Models that probe data for signal and leakage, with pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from ..functions.random import fast_uniform, uniform
from ..sources.tables import materialised
from . import joint
from . import ranking as R

#: The penalty of the linear models, over two, on squared weights of features of unit deviation.
RIDGE = 1e-3
#: Rows of a task of pyspark.ml's trees, which keep all rows of a part in memory several times.
TREE_ROWS = 200_000


def partitioned(df: DataFrame, without: Sequence[str]) -> tuple[list[str], list[str]]:
    """(numeric or boolean columns, all others), apart from ``without``."""
    fields = [f for f in df.schema.fields if f.name not in without]
    number = [f.name for f in fields if isinstance(f.dataType, (NumericType, BooleanType))]
    return number, [f.name for f in fields if f.name not in number]


def preparation(numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """Median for missing numbers, then unit variance around 0; categories as indicators, unknown and missing ones as one of their own."""
    steps: list = []
    inputs = []
    if numeric:
        steps += [Imputer(strategy="median", inputCols=list(numeric), outputCols=[f"{c}__i" for c in numeric]), VectorAssembler(inputCols=[f"{c}__i" for c in numeric], outputCol="_n"), StandardScaler(inputCol="_n", outputCol="_s", withMean=True)]
        inputs.append("_s")
    if categorical:
        steps += [StringIndexer(inputCols=list(categorical), outputCols=[f"{c}__x" for c in categorical], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}__x" for c in categorical], outputCols=[f"{c}__o" for c in categorical], handleInvalid="keep")]
        inputs += [f"{c}__o" for c in categorical]
    return [*steps, VectorAssembler(inputCols=inputs, outputCol="features")]


def learner(kind: str, seed: int = 42):
    if kind == "lr":
        return LogisticRegression(featuresCol="features", labelCol="y", probabilityCol="_pv", maxIter=50, regParam=RIDGE)
    if kind == "gbt":
        return GBTClassifier(featuresCol="features", labelCol="y", maxIter=20, maxDepth=3, seed=seed)
    raise ValueError(f"no learner {kind!r}")


def fit_predict(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, kind: str, keep: Sequence[str] = ()) -> DataFrame:
    """test's (keep, y, p): a model of ``features`` learnt on train."""
    numeric, categorical = partitioned(train.select(*features), [])
    ready = lambda df: df.select(*keep, *(F.col(c).cast("double").alias(c) for c in numeric), *(F.col(c).cast("string").alias(c) for c in categorical), F.col(label).cast("double").alias("y"))
    rows = ready(train)
    if kind == "gbt" and (parts := -(-rows.count() // TREE_ROWS)) > rows.rdd.getNumPartitions():
        rows = materialised(rows.repartition(parts))
    model = Pipeline(stages=[*preparation(numeric, categorical), learner(kind)]).fit(rows)
    out = model.transform(ready(test))
    return out.select(*keep, F.col("y").cast("int").alias("y"), vector_to_array(F.col("_pv" if kind == "lr" else "probability"))[1].alias("p"))


def stratified_folds(df: DataFrame, key: str, label: str, folds: int, seed: int, name: str = "fold") -> DataFrame:
    """The rows of df whose label is 0 or 1, with a fold from 0 on: the rows of each label are dealt out in turn, in hashed order, so all folds have its share of each label, give or take a row."""
    rows = None
    for value in (0, 1):
        own = R.ranked(df.where(F.col(label).cast("int") == value), uniform(seed, "folds", F.col(key)), [key])
        rows = own if rows is None else rows.unionByName(own)
    return rows.withColumn(name, F.pmod(F.col("rn") - 1, F.lit(folds)).cast("int")).drop("rn")


def held_out(df: DataFrame, key: str, share: float, seed: int, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a draw for each key, or, given a 0/1 label, with a share of hundredths of each label's rows."""
    if label is None:
        u = fast_uniform(seed, "hold-out", F.col(key))
        return df.where(u >= share), df.where(u < share)
    rows = materialised(stratified_folds(df, key, label, 100, seed, "_fold"))
    return tuple(rows.where(c).drop("_fold") for c in (F.col("_fold") >= round(100 * share), F.col("_fold") < round(100 * share)))


def prepared(df: DataFrame, features: Sequence[str], label: str, keep: Sequence[str], *, written: bool = True) -> tuple[DataFrame, joint.Shape, dict[str, tuple[int, ...]]]:
    """(rows (keep, y, x) written once, their shape, the places of each feature in x): preparation() fitted on all rows, and every place scaled to unit deviation, as pyspark.ml's linear models do.

    written: False for rows that are made again by each step that reads them; df should be written then.
    """
    numeric, categorical = partitioned(df.select(*features), [])
    ready = df.select(*keep, *(F.col(c).cast("double").alias(f"{c}__n") for c in numeric), *(F.col(c).cast("string").alias(f"{c}__c") for c in categorical), F.col(label).cast("double").alias("y"))
    model = Pipeline(stages=preparation([f"{c}__n" for c in numeric], [f"{c}__c" for c in categorical])).fit(ready)
    rows = model.transform(ready).select(*keep, "y", vector_to_array("features").alias("x"), "features")
    rows = materialised(rows) if written else rows
    found = rows.agg(Summarizer.std(F.col("features")).alias("s")).first()["s"]  # one row
    deviations = found.toArray() if found is not None else np.zeros(0)
    encoder = next((m for m in model.stages if hasattr(m, "categorySizes")), None)
    places, at = {c: (i,) for i, c in enumerate(numeric)}, len(numeric)
    for c, n in zip(categorical, encoder.categorySizes if encoder else [], strict=True):
        places[c] = tuple(range(at, at + n))
        at += n
    if len(deviations) not in (0, at):
        raise ValueError(f"{len(deviations)} places, {at} expected")
    scale = np.divide(1.0, deviations, out=np.zeros(at), where=deviations > 0) if len(deviations) else np.zeros(at)
    return rows.drop("features"), joint.Shape(0, at, scale), places


def hold_outs(df: DataFrame, key: str, label: str, seeds: Sequence[int], share: float) -> DataFrame:
    """df, written, with ``test``, an array of a boolean for each seed: whether the row is among the ``share`` of its 0/1 label's rows that have the lowest draws. Rows with other labels are in no test.

    Shares are exact. All seeds' bounds come from two aggregations: counts of the draws' leading bits, then ranks within the one bin in which each bound lies.
    """
    draws = F.array(*(F.shiftrightunsigned(F.xxhash64(F.lit(int(s)), F.lit("hold-out"), F.col(key)), 1) for s in seeds))
    y = F.col(label).cast("int")
    rows = materialised(df.withColumn("_u", draws))
    each = rows.where(y.isin(0, 1)).select(y.alias("_y"), F.col(key).alias("_k"), F.posexplode("_u").alias("_s", "_v"))
    sizes = {r["_y"]: r["n"] for r in rows.where(y.isin(0, 1)).groupBy(y.alias("_y")).agg(F.count("*").alias("n")).collect()}
    bits = min(20, max(4, max(sizes.values(), default=1).bit_length() - 14))  # a task counts 2^bits bins of each seed and label; up to 2^14 rows of a bin are ranked
    wanted = F.lit(0)
    for value, n in sizes.items():
        wanted = F.when(F.col("_y") == value, round(share * n)).otherwise(wanted)
    leading = F.shiftright("_v", 63 - bits)
    counts = each.groupBy("_s", "_y", leading.alias("_bin")).agg(F.count("*").alias("_n"))
    until = F.sum("_n").over(Window.partitionBy("_s", "_y").orderBy("_bin"))  # of 2^bits rows
    bounds = counts.withColumn("_until", until).where((F.col("_until") >= wanted) & (F.col("_until") - F.col("_n") < wanted)).select("_s", "_y", "_bin", (wanted - F.col("_until") + F.col("_n")).alias("_inside"))
    own = each.withColumn("_bin", leading).join(F.broadcast(bounds), ["_s", "_y", "_bin"])  # a row for each seed and label
    last = own.withColumn("_r", F.row_number().over(Window.partitionBy("_s", "_y").orderBy("_v", "_k"))).where(F.col("_r") == F.col("_inside")).select("_s", "_y", "_v", "_k").collect()
    kind = df.schema[key].dataType
    flags = [F.lit(False)] * len(seeds)
    for r in last:
        inside = F.struct(F.col("_u")[r["_s"]], F.col(key)) <= F.struct(F.lit(r["_v"]), F.lit(r["_k"]).cast(kind))
        flags[r["_s"]] = F.when(y == r["_y"], inside).otherwise(flags[r["_s"]])
    return rows.withColumn("test", F.array(*flags)).drop("_u")


def cross_validated(df: DataFrame, key: str, features: Sequence[str], label: str, kind: str, *, folds: int = 5, seed: int = 42) -> DataFrame:
    """(key, fold, y, p) of every row whose label is 0 or 1, each scored by a model that didn't see its fold; folds are stratified by the label. Linear models ("lr") of all folds are fitted together."""
    rows = materialised(stratified_folds(df, key, label, folds, seed, "_fold"))  # read by every fold
    if kind == "lr":
        ready, shape, _ = prepared(rows.withColumn("flags", F.array(*(F.col("_fold") != k for k in range(folds)))), features, label, [key, "_fold", "flags"])
        weights = joint.fit(ready, shape, [joint.Problem(k) for k in range(folds)], l2=RIDGE)
        out = joint.predicted(ready, shape, weights, [key, "_fold", "y"])
        return out.select(key, F.col("y").cast("int").alias("y"), F.col("p")[F.col("_fold")].alias("p"), F.col("_fold").alias("fold"))
    parts = [fit_predict(rows.where(F.col("_fold") != k), rows.where(F.col("_fold") == k), features, label, kind, [key]).withColumn("fold", F.lit(k)) for k in range(folds)]
    return reduce(DataFrame.unionByName, parts)


def bins_of(of: DataFrame, numeric: Sequence[str], categorical: Sequence[str], bins: int = 32, error: float = 1e-3) -> Column:
    """``bins`` array<int>: each number's place among quantiles of its column in ``of``, each category's by falling frequency there; ``bins`` for what is missing. Rarer and new categories share the last bin."""
    edges = of.select(*(F.col(c).cast("double").alias(c) for c in numeric)).approxQuantile(list(numeric), [i / bins for i in range(1, bins)], error) if numeric else []
    places = []
    for c, cuts in zip(numeric, edges, strict=True):
        x = F.col(c).cast("double")
        cuts = sorted(set(cuts))
        at = reduce(lambda a, b: a + b, ((F.lit(e) < x).cast("int") for e in cuts), F.lit(0))
        places.append(F.when(x.isNull() | F.isnan(x), bins).otherwise(at))
    for c in categorical:
        most = [r[0] for r in of.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(bins - 1).collect()]
        at = F.coalesce(F.element_at(F.create_map(*(x for i, v in enumerate(most) for x in (F.lit(v), F.lit(i)))), F.col(c).cast("string")), F.lit(bins - 1)) if most else F.lit(0)
        places.append(F.when(F.col(c).isNull(), bins).otherwise(at))
    return F.array(*places).cast("array<int>").alias("bins")


def binned(df: DataFrame, of: DataFrame, numeric: Sequence[str], categorical: Sequence[str], keep: Sequence[str], bins: int = 32, error: float = 1e-3) -> DataFrame:
    """df's (keep, bins_of())."""
    return df.select(*keep, bins_of(of, numeric, categorical, bins, error))


def hist_gbt(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, keep: Sequence[str], *, bins: int = 32, **options) -> DataFrame:
    """test's (keep, y, p) by boosted trees over binned features; missing values go to the side of each split that they fit better, so nothing is put in for them. Null labels teach nothing."""
    numeric, categorical = partitioned(train.select(*features), [])
    both = train.where(F.col(label).isNotNull()).select(*features, *keep, F.col(label).cast("double").alias("y"), F.lit(True).alias("_train")).unionByName(test.select(*features, *keep, F.col(label).cast("double").alias("y"), F.lit(False).alias("_train")))
    rows = materialised(binned(both, train, numeric, categorical, [*keep, "y", "_train"], bins))
    model = joint.fit_boosted(rows.where("_train"), len(numeric) + len(categorical), bins, **options)
    out = joint.predict_boosted(rows.where("not _train"), model, [*keep, "y"])
    return out.select(*keep, F.col("y").cast("int").alias("y"), "p")


def auc_of(scored: DataFrame) -> float | None:
    return R.roc_auc(scored.withColumn("p", F.round("p", 9))).first()["auc"]


def hashed_id(key: Column, buckets: int = 16) -> list[Column]:
    """Numbers that only depend on an id; nothing should be learnable from them."""
    return [(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(i)), key.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)).alias(f"h{i}") for i in range(buckets // 4)]


def trap_panel(df: DataFrame, key: str, features: Sequence[str], traps: Sequence[str], label: str, seeds: Sequence[int], share: float = 0.3) -> DataFrame:
    """(seed, trap, auc, average_precision) of linear models on a stratified hold-out of each seed: of the features (trap null), and of them with each of the leaking columns.

    All seeds' models are fitted together: a step is one pass over the rows, whatever the number of seeds and columns. The scores of all are counted together too, and none of them is a row.
    """
    split = hold_outs(df.where(F.col(label).cast("int").isin(0, 1)), key, label, seeds, share).withColumn("flags", F.transform("test", lambda t: ~t))
    rows, shape, places = prepared(split, [*features, *traps], label, [key, "test", "flags"])
    without = tuple(i for c in features for i in places[c])
    sets = [without, *(tuple(sorted((*without, *places[t]))) for t in traps)]
    weights = joint.fit(rows, shape, [joint.Problem(s, seen) for s in range(len(seeds)) for seen in sets], l2=RIDGE)
    found = joint.held_out_metrics(rows, shape, weights, [s for s in range(len(seeds)) for _ in sets])
    out = [(int(seed), trap, *found[s * len(sets) + j]) for s, seed in enumerate(seeds) for j, trap in enumerate([None, *traps])]
    return df.sparkSession.createDataFrame(out, "seed int, trap string, auc double, average_precision double")


def trap_deltas(panel: DataFrame) -> DataFrame:
    """(trap, seed, auc_with, auc_without, delta, average_precision_delta) of trap_panel(): what each leaking column adds with each seed."""
    base = panel.where(F.col("trap").isNull()).select("seed", F.col("auc").alias("auc_without"), F.col("average_precision").alias("_b"))
    both = panel.where(F.col("trap").isNotNull()).join(F.broadcast(base), "seed")  # a row a seed
    return both.select("trap", "seed", F.col("auc").alias("auc_with"), "auc_without", (F.col("auc") - F.col("auc_without")).alias("delta"), (F.col("average_precision") - F.col("_b")).alias("average_precision_delta"))


def trap_delta(df: DataFrame, key: str, features: Sequence[str], trap: str, label: str, seeds: Sequence[int] = tuple(range(1, 11)), share: float = 0.3) -> DataFrame:
    """(seed, auc_with, auc_without, delta, average_precision_delta): trap_deltas() of one column."""
    return trap_deltas(trap_panel(df, key, features, [trap], label, seeds, share)).drop("trap")


def trap_verdicts(deltas: DataFrame, least_mean: float, least_each: float) -> DataFrame:
    """(check, ok, mean, least) of trap_delta(): whether the column leaks as much as it is meant to, on average and with every seed."""
    one = deltas.agg(F.avg("delta").alias("mean"), F.min("delta").alias("least"))
    return one.select(F.lit("leakage_trap").alias("check"), F.coalesce((F.col("mean") >= least_mean) & (F.col("least") >= least_each), F.lit(False)).alias("ok"), "mean", "least")
