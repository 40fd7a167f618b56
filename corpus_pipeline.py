"""A corpus pipeline: five stages over ``documents``, each written as Parquet to the shared folder and read back as the next one's input.

Every stage but the last returns the columns of its input. Toxic documents go; lines that recur across sites stay in one document (a document left without any line
goes, as all it had stands elsewhere); one document of each group of near duplicates stays, that of the smallest id; documents with a
passage of a benchmark item go; the rest are encoded. Null and empty texts pass every stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrand.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, toxicity
from tallyrand.llm._spark import checkpointed, clean_name, removed, shared_dir, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic."""
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"))
    return scored.where(~F.col("toxic")).select(docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur across sites."""
    out = line_dedup.dedup_lines(docs).where((F.col("n_removed") == 0) | (F.trim(F.translate("text", "\n", " ")) != ""))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and the name of a column of longs that is different in every row: doc_id, or where ids are null or repeated one that is put in."""
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("doc_id").isNull() | (F.col("n") > 1)).isEmpty():
        return docs, "doc_id"
    key = clean_name(docs, "row_key")
    return checkpointed(docs.withColumn(key, F.monotonically_increasing_id())), key


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest id. Rows of one id are one document only if their texts are near duplicates; then the first by text stays; rows without an id stay."""
    rows, key = keyed(docs)
    found = checkpointed(jaccard_join.near_duplicates(rows, id_col=key)).select(F.col("doc_id").alias(key), "component_id")
    if key == "doc_id":
        gone = found.where("doc_id <> component_id").select("doc_id")
    else:
        group = clean_name(rows, "component_id")
        placed = rows.where(F.col("doc_id").isNotNull()).join(found.withColumnRenamed("component_id", group), key)
        order = F.struct("doc_id", "text", *(c for c in docs.columns if c not in ("doc_id", "text")), key)
        first = placed.groupBy(group).agg(F.min(order).alias("row")).select(F.col(f"row.{key}").alias(key))
        gone = placed.select(key).join(first, key, "left_anti")
    return rows.join(gone, key, "left_anti").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    rows, key = keyed(docs)
    hits = decontaminate.contaminated(rows.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(hits, key, "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, ids_sha256, whole): ids packed as little-endian unsigned 32-bit integers; whole: decoding gives the text back."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    both = byte_bpe.encode(rows, path=path, pattern=public_tokenizers.PATTERN, bytes_col="decoded", keep=["doc_id", "source", "text_sha256"])
    return both.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), (F.sha2("decoded", 256) == F.col("text_sha256")).alias("whole"))


STAGES = [("toxicity", toxic), ("line dedup", repeated_lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("byte-level BPE", tokens)]

#: SQL can't express the classifier and the alignment; the tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of ``documents``. Only the last stage's files stay; each other stage's go once the next one's are written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            removed(spark, f"{folder}/{k - 1}")
    return docs
