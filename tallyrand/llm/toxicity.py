"""Toxicity by classifier chains.

Categories are predicted one after the other. Each category's linear model sees a text's words and word beginnings and the probabilities of
all earlier categories; for training, those probabilities are out-of-fold predictions, so that a later model meets the same errors that it will meet on new texts.
The penalty leaves few terms with a weight, so a text is scored from the terms that it shares with them, once for all categories.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..operators import joint
from ._spark import checkpointed

WORDS, FOLD = "words", "fold"
#: Rows of the sample to a partition: a step of the solver sends one vector for each partition. Texts that are scored at once; the relative gain below which the solver stops.
FIT_ROWS, BATCH, TOLERANCE = 2000, 512, 1e-6
#: A word's beginning stands for its inflected and compounded forms.
STEM = 4
WORD = regex.compile(r"\p{L}+")


def terms_of(text: str | None) -> set[str]:
    """The words of a text, lower-cased, and, marked by ^, their beginnings; none for null."""
    found = set(WORD.findall((text or "").lower()))
    return found | {"^" + w[:STEM] for w in found}


@dataclass(frozen=True)
class Chain:
    """For each category, in order: the terms' weights, the earlier categories' weights and the constant. thresholds: where out-of-fold probabilities part each category best."""

    categories: tuple[str, ...]
    terms: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]
    earlier: tuple[tuple[float, ...], ...]
    constants: tuple[float, ...]
    thresholds: tuple[float, ...]

    def probabilities(self, texts: Iterable[str | None]) -> np.ndarray:
        """One row for each text, one column for each category."""
        place = {t: i for i, t in enumerate(self.terms)}
        weights = np.array(self.weights).reshape(len(self.categories), -1).T
        score = np.array([weights[[place[t] for t in terms_of(x) if t in place]].sum(0) for x in texts]).reshape(-1, len(self.categories)) + self.constants
        out = np.empty(score.shape)
        for i, earlier in enumerate(self.earlier):
            z = score[:, i] + (out[:, :i] @ np.array(earlier) if earlier else 0.0)
            out[:, i] = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        return out if self.terms else np.zeros(score.shape)

    def predict(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with a double column p_<category> for each category.

        Null and empty texts have no words and get the models' constants. Rows stay as they are, repeated ones too; columns of the names p_<category>, in any case, are replaced;
        other columns may have any name.
        """
        held = docs.sparkSession.sparkContext.broadcast(self)  # at most ``vocabulary`` terms
        names = [f"p_{c}" for c in self.categories]
        kept = [f for f in docs.schema.fields if f.name.lower() not in {n.lower() for n in names}]
        at, own = docs.columns.index(text_col), [i for i, f in enumerate(docs.schema.fields) if f in kept]
        # Working names by place, so none can clash with those of docs.
        rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))) if docs.columns else docs
        schema = StructType([*(StructField(f"c{i}", docs.schema.fields[i].dataType) for i in own), *(StructField(f"p{i}", DoubleType()) for i in range(len(names)))])

        def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, BATCH):
                    batch = whole.slice(start, BATCH)
                    p = held.value.probabilities(batch.column(at).to_pylist())
                    yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in own), *(pa.array(p[:, k]) for k in range(p.shape[1]))], names=schema.names)

        return rows.mapInArrow(judged, schema).toDF(*(f.name for f in kept), *names)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where fewest ones lie below and zeros above, midway on the logit scale between two of the values; of several such places the widest. 0.5 with one class only."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(p, kind="stable")
    p, y = np.clip(p[order], 1e-12, 1 - 1e-12), y[order]
    logit = np.log(p / (1 - p))
    gaps = np.flatnonzero(np.diff(logit) > 0)  # a cut between places i and i + 1
    if not len(gaps):
        return 0.5
    wrong = np.cumsum(y)[gaps] + (len(y) - y.sum()) - np.cumsum(1 - y)[gaps]
    best = gaps[wrong == wrong.min()]
    at = best[np.argmax(logit[best + 1] - logit[best])]
    return 1 / (1 + math.exp(-(logit[at] + logit[at + 1]) / 2))


def sampled(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_col: str, text_col: str, sample_rows: int) -> DataFrame:
    """(id, h, y0, y1, ..., text) of at most ``sample_rows`` rows of docs, whatever their ids: of the labelled (id, text) pairs, each counted once, those lowest by a hash. h: a hash of the text."""
    labelled = labels.where(F.col(id_col).isNotNull() & F.greatest(*(F.col(c).isNull().cast("int") for c in [*categories, categories[0]])).eqNullSafe(0))
    ys = [f"y{i}" for i in range(len(categories))]
    labelled = labelled.groupBy(F.col(id_col).alias("id")).agg(*(F.max(c).cast("double").alias(y) for y, c in zip(ys, categories, strict=True)))
    picked = labelled.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    # Both broadcasts have sample_rows rows at most; repeats are dropped before and after the texts are fetched, in each task first.
    pairs = rows.select("id", "h").join(F.broadcast(picked), "id").distinct().orderBy(F.xxhash64("id", "h"), "id", "h").limit(sample_rows)
    return rows.join(F.broadcast(pairs), ["id", "h"]).groupBy("id", "h", *ys).agg(F.max("text").alias("text"))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, as its terms."""
    for batch in batches:
        found = pa.array([sorted(terms_of(x)) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*batch.schema.names[:-1], WORDS])


def _numbered(sample: DataFrame, vocabulary: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(columns, terms): the words of each row that the vocabulary has, as their places in it."""
    held = sample.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = held.value.get
        for batch in batches:
            terms = [sorted(i for i in map(place, words) if i is not None) for words in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(terms, pa.list_(pa.int32()))], names=[*columns, "terms"])

    schema = sample.select(*columns).withColumn("terms", F.array(F.lit(0))).schema
    return sample.select(*columns, WORDS).mapInArrow(placed, schema)


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 12_000, folds: int = 3, vocabulary: int = 20_000, least_docs: int = 3, penalty: float = 3.6, iterations: int = 40) -> Chain:
    """A chain over ``categories``, 0/1 columns of labels (id, categories), for the texts of docs.

    It is fitted on a bounded sample: ``sample_rows`` rows at most, whole texts, see sampled(). Its terms are those of the sample that ``least_docs`` of its texts have,
    the ``vocabulary`` most frequent ones at most. Labels with a null id or a null category are left out;
    of repeated labels of an id one counts, the highest value of each category. A category that has one value only is predicted as that value; without any term all
    probabilities are 0. The penalty, ``penalty`` over the number of sampled texts, is on absolute weights of features of unit deviation: terms that don't matter get none, so the many rare terms of a long text add nothing up.

    A category's models, of all rows and without each fold, are fitted together: a step is one pass over the sample. The driver gets sums for each term, and a probability of each sampled row.
    """
    ys = [f"y{i}" for i in range(len(categories))]
    rows = sampled(docs, labels, categories, id_col, text_col, sample_rows)
    rows = rows.select(*ys, F.pmod(F.xxhash64(F.lit("fold"), "id", "h"), F.lit(folds)).cast("long").alias(FOLD), "text")
    sample = checkpointed(rows.mapInArrow(_listed, f"{''.join(f'{y} double, ' for y in ys)}{FOLD} long, {WORDS} array<string>"))  # read several times
    in_fold = {r[FOLD]: r["count"] for r in sample.groupBy(FOLD).count().collect()}
    n = sum(in_fold.values())
    counts = sample.select(F.explode(WORDS).alias("t")).groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs)
    frequent = counts.orderBy(F.desc("n"), "t").limit(vocabulary).collect()
    if not frequent:
        none = tuple(() for _ in categories)
        return Chain(tuple(categories), (), none, none, tuple(-math.inf for _ in categories), tuple(0.5 for _ in categories))
    terms, share = [r["t"] for r in frequent], np.array([r["n"] for r in frequent]) / n
    deviation = np.sqrt(share * (1 - share) * n / max(1, n - 1))
    scale = np.divide(1.0, deviation, out=np.zeros(len(terms)), where=deviation > 0)
    # A fold that holds all rows leaves none to learn from; its rows then get the full model's values.
    apart = [k for k in range(folds) if 0 < in_fold.get(k, 0) < n]
    flags = F.array(F.lit(True), *(F.col(FOLD) != k for k in apart))
    parts = -(-n // FIT_ROWS)
    rows = checkpointed(_numbered(sample.coalesce(parts), terms, [*ys, FOLD]).withColumns({"flags": flags, "x": F.array().cast("array<double>")}))
    model_of = F.lit(0)
    for place, k in enumerate(apart):
        model_of = F.when(F.col(FOLD) == k, place + 1).otherwise(model_of)
    weights, earlier, constants, thresholds = [], [], [], []
    for i in range(len(categories)):
        if i:
            spread = rows.agg(*(F.coalesce(F.stddev_samp(F.col("x")[j]), F.lit(0.0)) for j in range(i))).first()
            scale = np.append(scale[: len(terms)], [1 / x if x > 0 else 0.0 for x in spread])
        shape = joint.Shape(len(terms), i, scale)
        found = joint.fit(rows.withColumn("y", F.col(ys[i])), shape, [joint.Problem(k) for k in range(1 + len(apart))], l1=penalty / n, steps=iterations, tolerance=TOLERANCE)
        whole = found[0, :-1] * scale
        weights.append(whole[: len(terms)])
        earlier.append(whole[len(terms) :])
        constants.append(float(found[0, -1]))
        kept = [*ys, FOLD, "flags", "terms", "x"]
        scored = joint.predicted(rows, shape, found, kept).withColumn("p", F.col("p")[model_of])
        rows = checkpointed(scored.select(*(c for c in kept if c != "x"), F.concat("x", F.array("p")).alias("x"), "p"))
        pairs = np.array(rows.select("p", ys[i]).collect())  # sample_rows at most
        thresholds.append(best_threshold(pairs[:, 0], pairs[:, 1]))
    some = [k for k in range(len(terms)) if any(w[k] for w in weights)]
    return Chain(
        tuple(categories), tuple(terms[k] for k in some), tuple(tuple(float(w[k]) for k in some) for w in weights),
        tuple(tuple(map(float, w)) for w in earlier), tuple(constants), tuple(thresholds),
    )


def score(docs: DataFrame, labels: DataFrame, *, threshold: float | None = None, **options) -> DataFrame:
    """docs (doc_id, text, ...) with p_low_quality, p_toxic and toxic, learnt from labels (doc_id, quality 0/1, toxic 0/1) by fit() with ``options``.

    toxic: p_toxic is ``threshold`` or more, by default the one that parts the sample's out-of-fold probabilities best, and the text has a letter. The penalty shrinks all
    weights, so that threshold may be far below one half. Null and empty texts and texts without a letter are never toxic; neither is any text where the labels give no
    model. Rows are judged one by one, also repeated ones and those with null or repeated ids; columns named p_low_quality, p_toxic or toxic are replaced, all others are kept whatever their names; an empty table stays empty.
    """
    marks = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic"))
    chain = fit(docs, marks, ["low_quality", "toxic"], **options)
    has_words = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return chain.predict(docs).withColumn("toxic", has_words & (F.col("p_toxic") >= (chain.thresholds[1] if threshold is None else threshold)))
