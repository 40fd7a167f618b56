"""Language identification with string kernels.

A text's features are the letter n-grams of one to four characters that are present in it (a blended-spectrum presence kernel, hashed to
a fixed number of buckets, normalised by the number of n-grams of both texts). The kernel matrix is approximated from landmark texts (Nystroem), one ridge
regression per language is fitted in that space, and texts are scored in batches by two matrix products.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS, LONGEST = 15, 4
BUCKETS = 1 << BITS
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
BATCH, SLICE, PARTS = 64, 1 << 20, 64
UNKNOWN = "und"


@functools.cache
def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def mark(text: str, row: np.ndarray) -> bool:
    """Sets row[b] = 1 for the bucket of every n-gram that is present in the text; False if it has no letter. Runs of other characters, and the text's ends, count as one space.

    Long texts are read a slice at a time, each with the last characters of the one before.
    """
    found, carried = False, np.full(1, 32, np.uint32)
    for at in range(0, len(text), SLICE):
        codes = np.frombuffer(text[at : at + SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters()[codes]
        found |= bool(is_letter.any())
        end = [np.full(1, 32, np.uint32)] if at + SLICE >= len(text) else []
        padded = np.concatenate([carried, np.where(is_letter, codes, 32), *end]).astype(np.uint32)
        stays = np.ones(len(padded), bool)
        stays[1:] = (padded[1:] != 32) | (padded[:-1] != 32)
        chars = padded[stays]
        total = np.zeros(len(chars) + 1, np.uint32)
        for n in range(min(LONGEST, len(chars))):
            total = total[:-1] + chars[n:] * FACTORS[n]
            row[(total * FACTORS[0] + np.uint32(n) * FACTORS[3]) * FACTORS[1] >> np.uint32(32 - BITS)] = 1
        carried = chars[-(LONGEST - 1) :]
    return found


@dataclass(frozen=True)
class Model:
    """landmarks: packed bits (m, BUCKETS); weights: (m + 1, languages), the last row for the constant."""

    languages: tuple[str, ...]
    landmarks: np.ndarray
    weights: np.ndarray

    @functools.cached_property
    def unpacked(self) -> tuple[np.ndarray, np.ndarray]:
        bits = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
        return np.ascontiguousarray(bits.T), np.sqrt(bits.sum(1))

    def kernel(self, present: np.ndarray) -> np.ndarray:
        columns, norms = self.unpacked
        return (present @ columns) / np.maximum(np.sqrt(present.sum(1))[:, None] * norms, 1)

    def scores(self, present: np.ndarray) -> np.ndarray:
        return self.kernel(present).astype(np.float64) @ self.weights[:-1] + self.weights[-1]


def solve(present: list[np.ndarray], langs: list[str], n_landmarks: int, ridge: float) -> Model:
    """present: packed bits of each sampled text, in a fixed order. The first texts of every language serve as landmarks."""
    names = tuple(sorted(set(langs)))
    each = max(1, n_landmarks // len(names))
    chosen = [i for name in names for i in [j for j, x in enumerate(langs) if x == name][:each]]
    model = Model(names, np.array([present[i] for i in chosen]), np.zeros((len(chosen) + 1, len(names))))
    blocks = (np.unpackbits(np.array(present[i : i + BATCH]), axis=1).astype(np.float32) for i in range(0, len(present), BATCH))
    k_nm = np.concatenate([model.kernel(x) for x in blocks]).astype(np.float64)
    values, vectors = np.linalg.eigh(k_nm[chosen])
    kept = values > 1e-6 * values[-1]
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    features = np.hstack([k_nm @ whiten, np.ones((len(langs), 1))])
    targets = np.where(np.array(langs)[:, None] == np.array(names)[None], 1.0, -1.0)
    penalty = ridge * np.eye(features.shape[1])
    penalty[-1, -1] = 0
    fitted = np.linalg.solve(features.T @ features + penalty + 1e-9 * np.eye(len(penalty)), features.T @ targets)
    return Model(names, model.landmarks, np.vstack([whiten @ fitted[:-1], fitted[-1:]]))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, at, bits = [], [], []
        for text, name, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            row = np.zeros(BUCKETS, np.uint8)
            mark(text, row)
            lang.append(name)
            at.append(k)
            bits.append(np.packbits(row).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(at, pa.int64()), pa.array(bits, pa.binary())], names=["lang", "at", "bits"])


def fit(docs: DataFrame, *, sample_rows: int = 2000, n_landmarks: int = 192, ridge: float = 0.1) -> Model | None:
    """A model from docs (doc_id, text, lang): rows with a null language or id or without a letter teach nothing; None if none is left.

    It is fitted on a bounded sample: ``sample_rows`` rows in all (or two a language, if that is more), the same number of each language: of the (id, text) pairs, each counted once, those lowest by a hash. What the
    driver gets is their packed features, 4 KB a row, however often an id recurs.
    """
    able = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).withColumn("_h", F.xxhash64("text"))
    langs = able.select("lang").distinct().count()
    if not langs:
        return None
    most = max(2, sample_rows // langs)
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id", "_h"), "doc_id", "_h"))
    # Repeats go in each task first. Then ranks within parts of each language, so that a language's task gets a bounded number of rows.
    pairs = able.select("doc_id", "lang", "_h").distinct().withColumn("part", F.pmod(F.xxhash64("doc_id", "_h", F.lit("part")), F.lit(PARTS)))
    pairs = pairs.withColumn("at", rank("lang", "part")).where(F.col("at") <= most).withColumn("at", rank("lang")).where(F.col("at") <= most).drop("part")
    sample = able.join(F.broadcast(pairs), ["doc_id", "lang", "_h"])  # at most sample_rows pairs, or two per language
    sample = sample.groupBy("lang", "at").agg(F.max("text").alias("text"))
    rows = sample.select("text", "lang", F.col("at").cast("long")).mapInArrow(_packed, "lang string, at long, bits binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["at"], bytes(r["bits"])))
    return solve([np.frombuffer(r["bits"], np.uint8) for r in rows], [r["lang"] for r in rows], n_landmarks, ridge)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(every column of docs but text, lang_pred, score): the language with the highest score of each whole text.

    score: that regression's value, of -1 to 1, carried to 0 to 1; of equal values the language that sorts first has its way. Columns named lang_pred or score, in any case, are replaced. Null texts, texts without a letter and all texts where there is no model
    get ``und`` and 0. Repeated rows are judged one by one; an empty table stays empty.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    names_in = docs.columns
    held = docs.sparkSession.sparkContext.broadcast(model)  # landmarks: bounded by their number
    others = [i for i, c in enumerate(docs.columns) if c.lower() not in ("text", "lang_pred", "score")]
    at = docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        present = np.zeros((BATCH, BUCKETS), np.float32)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                present[:] = 0
                able = np.array([own is not None and mark(t or "", row) for t, row in zip(batch.column(at).to_pylist(), present, strict=False)])
                names, values = [UNKNOWN] * len(able), np.zeros(len(able))
                if able.any():
                    scores = own.scores(present[: len(able)])
                    best = scores.argmax(1)
                    names = [own.languages[b] if a else UNKNOWN for a, b in zip(able, best, strict=True)]
                    values = np.where(able, np.clip((1 + scores.max(1)) / 2, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in others), pa.array(names, pa.string()), pa.array(values)], names=[*(names_in[i] for i in others), "lang_pred", "score"])

    schema = StructType([*(docs.schema.fields[i] for i in others), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(judge, schema)
