"""Ranked lexical search with dual-sorted wavelet trees.

A shard holds the postings of some documents: for each term a list ordered by impact, highest first. All lists in a row are stored as a wavelet tree over the documents' numbers, so
the same postings can be entered by term and by document. A node of the tree stands for a range of documents; partitions are stable, so the first posting of a list inside a node has the
list's highest impact there, and the sum of these over a query's terms bounds every score in the node. The search opens nodes by their bounds, best first and many at a time, and leaves those that can't
reach the k-th score; what it returns is exact.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import checkpointed

#: (item, term) pairs that are searched for at once, postings to a shard, nodes that are opened at once.
BLOCK_PAIRS, SHARD_POSTINGS, BEAM = 1_000_000, 1 << 20, 4096
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Of ASCII, A-Z become a-z, letters and digits stay, and all else parts terms; bytes of other characters stay.
_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
_UPPER = "".join(map(chr, range(65, 91)))


def query_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, term), once each."""
    found = F.regexp_extract_all(F.translate(F.col(text_col), _UPPER, _UPPER.lower()), F.lit(TERM), F.lit(0))
    return items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.explode(found).alias("term")).distinct()


@dataclass(frozen=True)
class WaveletTree:
    """ones: for each level the ones before every place; zeros: zeros of each level; impacts: for each level, and behind the last, the impact at every place; begins: where each term's list begins."""

    ones: tuple[np.ndarray, ...]
    zeros: tuple[int, ...]
    impacts: tuple[np.ndarray, ...]
    begins: np.ndarray

    @classmethod
    def of(cls, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_terms: int, n_docs: int) -> WaveletTree:
        order = np.lexsort((docs, -impacts, terms))
        docs, held = docs[order].astype(np.int32), impacts[order].astype(np.int32)
        ones, zeros, levels = [], [], [held]
        for k in reversed(range(max(1, (n_docs - 1).bit_length()))):
            one = docs >> k & 1 != 0
            before = np.zeros(len(docs) + 1, np.int32)
            np.cumsum(one, out=before[1:])
            ones.append(before)
            zeros.append(len(docs) - int(before[-1]))
            docs, held = np.concatenate([docs[~one], docs[one]]), np.concatenate([held[~one], held[one]])
            levels.append(held)
        return cls(tuple(ones), tuple(zeros), tuple(levels), np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=n_terms))]))

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): all with a score of ``floor`` or more that the k-th best score doesn't rule out."""
        left, right = self.begins[terms], self.begins[terms + 1]
        some = left < right
        found: list[tuple[np.ndarray, np.ndarray]] = []
        scores = np.empty(0, np.int64)
        # A chunk: level, each node's first document over the level's width, its bound, and for each pair of node and term the node, the weight and the list's part in the node.
        first = (0, np.zeros(1, np.int64), None, np.zeros(int(some.sum()), np.int64), weights[some], left[some], right[some])
        pending: list[tuple[int, int, tuple]] = [(0, 0, first)] if some.any() else []
        pushed = 0
        while pending:
            bound, _, (level, nodes, bounds, at, w, lo, hi) = heapq.heappop(pending)
            if bounds is not None:
                if -bound < floor:
                    break  # and so are all others
                nodes, bounds, at, w, lo, hi = _kept(bounds >= floor, nodes, bounds, at, w, lo, hi)
            while len(nodes):
                if level == len(self.ones):
                    found.append((nodes, bounds))
                    scores = np.concatenate([scores, bounds])
                    if len(scores) >= k:
                        scores = np.partition(scores, len(scores) - k)[-k:]
                        floor = max(floor, int(scores.min()))
                    break
                ones, z = self.ones[level], self.zeros[level]
                lo1, hi1 = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
                lo, hi = np.concatenate([lo - lo1, z + lo1]), np.concatenate([hi - hi1, z + hi1])
                at, w = np.concatenate([2 * at, 2 * at + 1]), np.concatenate([w, w])
                some = lo < hi
                lo, hi, at, w = lo[some], hi[some], at[some], w[some]
                nodes = (2 * nodes[:, None] + np.arange(2)).ravel()
                level += 1
                bounds = np.zeros(len(nodes), np.int64)
                np.add.at(bounds, at, w * self.impacts[level][lo])
                nodes, bounds, at, w, lo, hi = _kept(bounds >= floor, nodes, bounds, at, w, lo, hi)
                if len(nodes) > BEAM:
                    ahead = np.zeros(len(nodes), bool)
                    ahead[np.argpartition(-bounds, BEAM)[:BEAM]] = True
                    later = _kept(~ahead, nodes, bounds, at, w, lo, hi)
                    pushed += 1
                    heapq.heappush(pending, (-int(later[1].max()), pushed, (level, *later)))
                    nodes, bounds, at, w, lo, hi = _kept(ahead, nodes, bounds, at, w, lo, hi)
        docs, totals = (np.concatenate([f[i] for f in found] or [np.empty(0, np.int64)]) for i in (0, 1))
        return docs[totals >= floor], totals[totals >= floor]


def _kept(stays: np.ndarray, nodes, bounds, at, w, lo, hi) -> tuple:
    """A chunk's nodes that stay, with their pairs renumbered."""
    if stays.all():
        return nodes, bounds, at, w, lo, hi
    own = stays[at]
    return nodes[stays], bounds[stays], (np.cumsum(stays) - 1)[at[own]], w[own], lo[own], hi[own]


def _counted(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(shard, doc_id, n, terms, tfs) of documents with a term; terms, tfs: those of the vocabulary, as packed 32-bit integers."""
    held = docs.sparkSession.sparkContext.broadcast({t.encode(): i for t, i in vocabulary.items()})  # BLOCK_PAIRS at most, or one item's

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held.value.get
        for batch in batches:
            texts = batch.column(2)
            texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()
            n, terms, tfs = [], [], []
            for text in texts:
                words = (text or b"").translate(_BYTES).split()
                found = Counter(map(number, words))
                found.pop(None, None)
                n.append(len(words))
                terms.append(np.fromiter(found.keys(), np.int32, len(found)).tobytes())
                tfs.append(np.fromiter(found.values(), np.int32, len(found)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], names=["shard", "doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.spark_partition_id().alias("shard"), "doc_id", "text").mapInArrow(counted, "shard int, doc_id long, n long, terms binary, tfs binary")
    return rows.where("n > 0")


def _frequencies(postings: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term, summed in each task first."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=n_terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    found = np.zeros(n_terms, np.int64)
    for term, df in postings.select("terms").mapInArrow(summed, "term long, df long").groupBy("term").agg(F.sum("df")).collect():  # one row a term
        found[term] = df
    return found


def _searched(postings: DataFrame, queries: Sequence[tuple[np.ndarray, np.ndarray]], floors: np.ndarray, n_terms: int, n_docs: int, n_words: int, k: int) -> DataFrame:
    """(query, doc_id, score): each task's best documents for every query, k at most, of those that reach its floor."""
    held = postings.sparkSession.sparkContext.broadcast((queries, floors))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, floors = held.value
        floors = floors.copy()
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in queries]

        def shard(rows: list[pa.RecordBatch]) -> None:
            ids = np.concatenate([b.column(0).to_numpy() for b in rows])
            sizes = np.concatenate([b.column(1).to_numpy() for b in rows])
            parts = [x for b in rows for x in b.column(2).to_pylist()]
            terms, tf = np.frombuffer(b"".join(parts), np.int32), np.frombuffer(b"".join(x for b in rows for x in b.column(3).to_pylist()), np.int32).astype(np.int64)
            docs = np.repeat(np.arange(len(ids)), [len(x) // 4 for x in parts])
            m = 50 + 50 * sizes * n_docs // n_words
            tree = WaveletTree.of(terms, docs, 1_000_000_000 * tf // (1000 * tf + 20 * m[docs]), n_terms, len(ids))
            for q, (own, weights) in enumerate(queries):
                found, scores = tree.best(own, weights, k, int(floors[q]))
                if len(found):
                    all_ids, all_scores = np.concatenate([best[q][0], ids[found]]), np.concatenate([best[q][1], scores])
                    order = np.lexsort((all_ids, -all_scores))[:k]
                    best[q] = all_ids[order], all_scores[order]
                    if len(order) == k:
                        floors[q] = max(floors[q], all_scores[order[-1]])

        waiting, size = [], 0
        for batch in batches:
            ends = np.cumsum([len(x) // 4 for x in batch.column(2).to_pylist()])
            start = 0
            while start < batch.num_rows:  # cut where a shard is full
                behind = int(ends[start - 1]) if start else 0
                to = max(start + 1, int(np.searchsorted(ends, behind + SHARD_POSTINGS - size, "right")))
                waiting.append(batch.slice(start, to - start))
                size += int(ends[to - 1]) - behind
                start = to
                if size >= SHARD_POSTINGS or start < batch.num_rows:
                    shard(waiting)
                    waiting, size = [], 0
        if waiting:
            shard(waiting)
        for q, (ids, scores) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q, np.int64)), pa.array(ids), pa.array(scores)], names=["query", "doc_id", "score"])

    return postings.select("doc_id", "n", "terms", "tfs").where("doc_id is not null and octet_length(terms) > 0").mapInArrow(searched, "query long, doc_id long, score long")


def _block(docs: DataFrame, pairs: list, k: int) -> DataFrame:
    """(query, doc_id, score) for one block's items, numbered as in sorted order, with all that can be among the k best."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, t in pairs}))}
    own: dict = {}
    for item, term in pairs:
        own.setdefault(item, []).append(vocabulary[term])
    postings = checkpointed(_counted(docs, vocabulary))
    n_docs, n_words, shards = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.count_distinct("shard"), F.lit(0))).first()
    df = _frequencies(postings, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    queries = []
    for item in sorted(own):
        terms = np.array(sorted(own[item]))
        terms = terms[(weights[terms] > 0) & (df[terms] > 0)]
        queries.append((terms, weights[terms]))
    find = lambda rows, floors: _searched(rows, queries, floors, len(vocabulary), n_docs, n_words, k)
    # The k-th scores of about the square root of all shards bound what the others need to send.
    step, ones = max(1, math.isqrt(max(0, shards - 1)) + 1), np.ones(len(queries), np.int64)
    first = checkpointed(find(postings.where(F.col("shard") % step == 0), ones))
    if step == 1:
        return first
    floors = ones.copy()
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")))
    for q, score in ranked.where(F.col("rank") == k).select("query", "score").collect():  # one row a query
        floors[q] = score
    return first.unionByName(find(postings.where(F.col("shard") % step != 0), floors))


def top_k(docs: DataFrame, items: DataFrame, *, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item, of equal scores the smaller id first; all, if there are fewer.

    Terms are runs of letters and digits of ASCII and of all other characters, A-Z lower-cased, of whole texts. A document scores the sum over the item's distinct terms of
    w * ((10^9 * tf) div (1000 * tf + 20 * m)), w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))), m = 50 + (50 * n * N) div L; N: documents with a term, L: all terms, n: the document's.

    Null and empty texts have no terms: such documents don't count, such items get no rows. Rows without an item id are left out; documents without an id count in N, L and df but aren't returned;
    repeated rows are documents of their own, and an item's repeated rows are one item. Other columns may have any name. Only terms of the items are indexed; items are taken in blocks of about BLOCK_PAIRS terms, each of which reads docs once, so the driver and
    the tasks hold a bounded part of them. A task holds SHARD_POSTINGS postings at a time, or one document's.
    """
    session = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pairs = checkpointed(query_terms(items, item_col, item_text_col))
    kind = pairs.schema["item"].dataType.simpleString()
    blocks = -(-pairs.count() // BLOCK_PAIRS)
    out = session.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    for b in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        if own:
            names = session.createDataFrame(list(enumerate(sorted({r.item for r in own}))), f"query long, item_id {kind}")
            out = out.unionByName(_block(rows, own, k).join(F.broadcast(names), "query").select("item_id", "doc_id", "score"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
