"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment.

The n-grams of all test items are counted over the whole corpus; an item's n-grams that aren't much more frequent than its others are its seeds. Texts send the places of n-grams that
pass a filter of the seeds, and a join by n-gram tells the items that they lead to. For each text and item, the passages around the seeds are aligned with the item, word by word,
which finds copies with words changed, left out or put in. The score is the alignment's share of what the whole item would reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words
from ._spark import checkpointed

MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of a filter for each n-gram in it, up to so many in all (16 MB), and how many of them an n-gram sets. A fuller filter lets more through to the joins, which are exact.
FILTER_EACH, FILTER_MOST, FILTER_HASHES = 128, 1 << 27, 3
#: Bytes of one of Spark's bitmaps, of which a filter is made.
BLOCK = 4096
#: Up to so many rows of seeds, runs or keys are broadcast; more are shuffled.
BROADCAST_ROWS = 200_000
FOUND = "doc_id long, item_id long, score double, start_word long, end_word long"


def _lowered(batch: pa.RecordBatch, column: int) -> pa.RecordBatch:
    return batch.set_column(column, batch.schema.names[column], pc.utf8_lower(batch.column(column)))


def texts(batch: pa.RecordBatch, column: int, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, words before each text, word hashes, n-gram hashes) of some texts at a time; n-grams that cross a text's end are 0 there."""
    at = 0
    for rows, data, offsets in _words.chunks(_lowered(batch, column), column):
        starts, before = _words.word_bounds(data, offsets, _words.SIGNS)
        words = _words.word_hashes(data, starts, _words.SIGNS)
        grams = _words.ngrams(words, n) if len(words) >= n else np.empty(0, np.uint64)
        ends = before[1:][np.diff(before) > 0]
        for k in range(1, n):
            cut = ends - k
            grams[cut[(cut >= 0) & (cut < len(grams))]] = 0
        yield at, before, words, grams
        at += rows.num_rows


def _bits(grams: np.ndarray, size: int) -> np.ndarray:
    """(FILTER_HASHES, n): the places of n-grams in a filter of ``size`` bits, a power of two."""
    return np.array([_words.mixed(grams * _words.PLACES[k]) & np.uint64(size - 1) for k in range(FILTER_HASHES)]).astype(np.int64)


def _passes(held: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Which n-grams can be in the filter, as a boolean each."""
    size = len(held) * 8
    out = np.ones(len(grams), bool)
    for k in range(FILTER_HASHES):  # few are left after the first
        left = np.flatnonzero(out)
        at = (_words.mixed(grams[left] * _words.PLACES[k]) & np.uint64(size - 1)).astype(np.int64)
        out[left] = held[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
    return out


def _filter(grams: DataFrame) -> Broadcast:
    """A filter of the n-grams (gram), merged on the executors; what the driver gets and sends is at most its bits."""
    n = grams.count()
    size = max(1 << 16, min(FILTER_MOST, 1 << max(1, n * FILTER_EACH - 1).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_bits(batch.column(0).to_numpy().view(np.uint64), size)))], names=["place"])

    # Numbered from 1, as bitmap buckets are; each is BLOCK bytes.
    at = F.col("place") + 1
    blocks = grams.mapInArrow(places, "place long").groupBy(F.bitmap_bucket_number(at).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    held = np.zeros(max(size // 8, BLOCK), np.uint8)
    for row in blocks.collect():
        held[(row["block"] - 1) * BLOCK : row["block"] * BLOCK] = np.frombuffer(row["bits"], np.uint8)
    return grams.sparkSession.sparkContext.broadcast(held)


def align(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment: Smith-Waterman with linear gaps, a row of the matrix at a time; each cell carries where its alignment begins."""
    here = np.arange(len(text) + 1)
    steps = here * -GAP
    last, begun = np.zeros(len(text) + 1, np.int64), here
    best = (0, 0, 0)
    for word in item:
        now, start = np.zeros(len(text) + 1, np.int64), here.copy()
        now[1:] = last[:-1] + np.where(text == word, MATCH, MISMATCH)
        start[1:] = np.where(last[:-1] > 0, begun[:-1], here[:-1])
        down = last + GAP > now
        now, start = np.where(down, last + GAP, now), np.where(down, begun, start)
        start[now <= 0] = here[now <= 0]
        np.maximum(now, 0, out=now)
        # Gaps along the row: the best of all cells to the left, each less its distance.
        lead = now + steps
        most = np.maximum.accumulate(lead)
        source = np.maximum.accumulate(np.where(lead == most, here, 0))
        last, begun = most - steps, start[source]
        j = int(last.argmax())
        if last[j] > best[0]:
            best = (int(last[j]), int(begun[j]), j)
    return best


def passage(words: np.ndarray, item: np.ndarray, begins: np.ndarray, least: float) -> tuple[float, int, int] | None:
    """(score, start, end) of an item's best passage in a text, where it reaches ``least``; begins, sorted: where the item would begin by each seed."""
    slack = len(item) // 2 + 4
    best = (least * MATCH * len(item) - 1e-9, 0, 0)
    # Seeds whose beginnings lie apart by more than the item's length belong to different passages.
    for part in np.split(begins, np.flatnonzero(np.diff(begins) > len(item)) + 1):
        lo, hi = max(0, int(part[0]) - slack), min(len(words), int(part[-1]) + len(item) + slack)
        score, start, end = align(words[lo:hi], item)
        if score > best[0]:
            best = (score, lo + start, lo + end)
    return (best[0] / (MATCH * len(item)), best[1], best[2]) if best[2] else None


def _counted(held: Broadcast, n: int):
    """(gram, df) of (text): in how many of a task's texts the n-grams are that the filter lets through, each of their counts some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, before, _, grams in texts(batch, 0, n):
                at = np.flatnonzero(_passes(held.value, grams) & (grams != 0))
                text, own = np.searchsorted(before, at, "right"), grams[at]
                order = np.lexsort((own, text))
                text, own = text[order], own[order]
                again = (text[1:] == text[:-1]) & (own[1:] == own[:-1])
                found.append(own[np.append(True, ~again)] if len(own) else own)
            own, df = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(df.astype(np.int64))], names=["gram", "df"])

    return run


def _runs(held: Broadcast, n: int):
    """(key, run, at, grams) of (key, text): the runs of n-grams in a row that the filter lets through, a hash of each, the place of its first one, and all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for first, before, _, grams in texts(batch, 1, n):
                at = np.flatnonzero(_passes(held.value, grams) & (grams != 0))
                if not len(at):
                    continue
                # Between the last n-gram of a text and the first of the next there are n - 1 that cross its end.
                head = np.flatnonzero(np.append(True, np.diff(at) > 1))
                size = np.diff(np.append(head, len(at)))
                place = np.arange(len(at)) - np.repeat(head, size)
                own = _words.mixed(np.add.reduceat(_words.mixed(grams[at] + place.astype(np.uint64) * _words.PLACES[3]), head) + size.astype(np.uint64) * _words.PLACES[4])
                text = np.searchsorted(before, at[head], "right") - 1
                blobs = [x.tobytes() for x in np.split(grams[at], head[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(keys[first + text]), pa.array(own.view(np.int64)), pa.array(at[head] - before[text]), pa.array(blobs, pa.binary())], names=["key", "run", "at", "grams"])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, gram, at) of (run, grams)."""
    for batch in batches:
        for own, blob in zip(batch.column(0), batch.column(1), strict=True):
            grams = np.frombuffer(blob.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), own.as_py())), pa.array(grams), pa.array(np.arange(len(grams)))], names=["run", "gram", "at"])


def _aligned(least: float):
    """(doc_id, item, score, start_word, end_word) of (doc_id, text, hits (item, begins, words))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hits = batch.column(0), batch.column(2)
            out: list[tuple] = []
            for first, before, words, _ in texts(batch.select([0, 1]), 1, 1):
                for t in range(len(before) - 1):
                    own = words[before[t] : before[t + 1]]
                    for hit in hits[first + t].values:
                        begins = np.sort(hit["begins"].values.to_numpy())
                        if found := passage(own, np.frombuffer(hit["words"].as_buffer(), np.uint64), begins, least):
                            out.append((ids[first + t].as_py(), hit["item"].as_py(), *found))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item", "score", "start_word", "end_word"])

    return run


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [words[before[i] : before[i + 1]].tobytes() for _, before, words, _ in texts(batch, 1, 1) for i in range(len(before) - 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["item_id", "words"])


def _item_grams(n: int):
    """(item, gram, place) of (item, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch.column(0), batch.column(1), strict=True):
                grams = _words.ngrams(np.frombuffer(words.as_buffer(), np.uint64), n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), item.as_py())), pa.array(grams.view(np.int64)), pa.array(np.arange(len(grams)))], names=["item", "gram", "place"])

    return run


def contaminated(docs: DataFrame, items: DataFrame, *, n: int = 3, least: float = 0.45, spread: float = 4.0, floor: int = 8) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): every item whose best passage in a text reaches ``least`` of the item's full score.

    docs (doc_id, text), items (item_id, text). Words are runs of letters and digits, lower-cased. An item's seeds are its n-grams that are in at most ``floor`` texts plus ``spread`` times the
    number that its median n-gram is in. Items of fewer than n words are never found; null texts are empty, items with a
    null id are left out. Repeated items and repeated rows are found each by itself, as are rows with a null id. Further columns are ignored; without items or texts the result is empty.
    Memory for an alignment grows with the text and the item, not with their product. Words and n-grams are compared by 64-bit hashes.
    """
    # Rows of one key have one id and one text; a key stands for all of them.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    found = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), F.col("text")).mapInArrow(_item_words, "item_id long, words binary")
    ids = checkpointed(found.where(F.octet_length("words") >= 8 * n).withColumn("item", F.xxhash64("words")))
    distinct = ids.groupBy("item").agg(F.first("words").alias("words"))
    grams = checkpointed(distinct.mapInArrow(_item_grams(n), "item long, gram long, place long"))
    counts = rows.select("text").mapInArrow(_counted(_filter(grams.select("gram").distinct()), n), "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))
    counted = grams.join(counts, "gram", "left").fillna(0, ["df"])
    usual = counted.groupBy("item").agg(F.percentile("df", 0.5).alias("usual"))
    seeds = checkpointed(counted.join(usual, "item").where(F.col("df") <= floor + spread * F.col("usual")).select("gram", "item", "place"))
    runs = checkpointed(rows.select("key", "text").mapInArrow(_runs(_filter(seeds.select("gram").distinct()), n), "key long, run long, at long, grams binary"))
    # A passage that many texts share is one run of n-grams, which meets the seeds once.
    own = runs.groupBy("run").agg(F.first("grams").alias("grams")).mapInArrow(_unpacked, "run long, gram long, at long")
    led = own.join(F.broadcast(seeds) if seeds.count() <= BROADCAST_ROWS else seeds, "gram").groupBy("run", "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("begins"))
    led = checkpointed(led)
    hits = runs.select("key", "run", "at").join(F.broadcast(led) if (led.agg(F.sum(F.size("begins"))).first()[0] or 0) <= BROADCAST_ROWS else led, "run").select("key", "item", F.explode(F.transform("begins", lambda b: b + F.col("at"))).alias("begin"))
    # A set, so that repeats of a row add nothing.
    hits = hits.groupBy("key", "item").agg(F.collect_set("begin").alias("begins"))
    hits = checkpointed(hits.join(distinct, "item").groupBy("key").agg(F.collect_list(F.struct("item", "begins", "words")).alias("hits")))
    # Few texts have a seed, so the others leave before any shuffle.
    some = rows.join(F.broadcast(hits.select("key")), "key", "left_semi") if hits.count() <= BROADCAST_ROWS else rows
    aligned = some.join(hits, "key").select("doc_id", "text", "hits").mapInArrow(_aligned(least), "doc_id long, item long, score double, start_word long, end_word long")
    return aligned.join(ids.select("item", "item_id"), "item").select("doc_id", "item_id", "score", "start_word", "end_word")
