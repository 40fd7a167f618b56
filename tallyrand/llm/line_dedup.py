"""Removal of lines that recur across sites.

Each line's hash gets a HyperLogLog sketch of the sites that it stands on; the sketches merge in the aggregation, also before the shuffle, so a line on every
page is a few bytes per task. Lines whose estimate is too close to the threshold to tell get an exact distinct count. A line on at least
``min_sites`` sites is boilerplate: it stays in the document of the smallest id that has it and goes from all others.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import checkpointed, met


def boilerplate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, min_chars: int = 1, lg_k: int = 12) -> DataFrame:
    """(line, keeper, n): the hash of every line of ``min_chars`` or more on ``min_sites`` distinct sites or more, the smallest id that has it and the number of documents.

    ``min_chars``: 1 leaves out blank lines only. Null sites are none; a line that recurs in a document counts once for it. Lines are compared by 64-bit hashes.
    """
    rows = lines(docs, id_col, text_col, site_col, min_chars)
    sketched = rows.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"), F.min("id").alias("keeper"), F.count("*").alias("n"))
    doubt = max(1, math.ceil(3 * 1.04 / math.sqrt(1 << lg_k) * min_sites))
    likely = checkpointed(sketched.where(F.col("sites") >= min_sites - doubt))
    near = likely.where(F.col("sites") <= min_sites + doubt).select("line", "n")
    exact = met(rows, near, "line").groupBy("line").agg(F.count_distinct("site").alias("exact"))
    return likely.join(exact, "line", "left").where(F.coalesce("exact", "sites") >= min_sites).select("line", "keeper", "n")


def lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_chars: int) -> DataFrame:
    long = F.filter(F.split(F.col(text_col), "\n", -1), lambda x: F.length(F.trim(x)) >= min_chars)
    hashes = F.array_distinct(F.transform(long, lambda x: F.xxhash64(F.trim(x))))
    return docs.select(F.col(id_col).alias("id"), F.col(site_col).alias("site"), F.explode(hashes).alias("line"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, min_chars: int = 1, lg_k: int = 12) -> DataFrame:
    """docs with boilerplate lines taken out of ``text_col`` and with n_lines and n_removed (long).

    The other lines stay as they are. Null texts stay null with no lines, empty texts have one empty line; rows with a
    null id are counted but not changed; rows of one id are treated as one document's; columns named n_lines or n_removed are replaced, others may have any name; an empty table stays
    empty. Lines are compared by 64-bit hashes, without outer blanks.
    """
    found = checkpointed(boilerplate(docs, id_col=id_col, text_col=text_col, site_col=site_col, min_sites=min_sites, min_chars=min_chars, lg_k=lg_k))
    # The places of a document's lines that go. Only these rows are shuffled where the lines are broadcast.
    able = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("at", "piece"))
    rows = able.where(F.length(F.trim("piece")) >= min_chars).select("id", "text", "at", F.xxhash64(F.trim("piece")).alias("line"))
    gone = met(rows, found, "line").where(F.col("id") != F.col("keeper")).groupBy("id", "text").agg(F.sort_array(F.collect_set("at")).alias("gone"))
    # The row goes along as one column, so no working column can clash with its names.
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    held = held.join(gone, ["id", "text"], "left").withColumn("pieces", F.split(F.col(f"row.`{text_col}`"), "\n", -1))
    # What stays are the slices before, between and behind the lines that go.
    before = F.concat(F.array(F.lit(-1)), F.col("gone"))
    ends = F.concat(F.col("gone"), F.array(F.size("pieces")))
    kept = F.flatten(F.transform(F.arrays_zip(before.alias("a"), ends.alias("b")), lambda x: F.slice(F.col("pieces"), x["a"] + 2, x["b"] - x["a"] - 1)))
    text = F.when(F.col("gone").isNull(), F.col(f"row.`{text_col}`")).otherwise(F.concat_ws("\n", kept))
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    total = F.when(F.col("pieces").isNull(), F.lit(0)).otherwise(F.size("pieces"))
    return held.select(*(text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names), total.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
