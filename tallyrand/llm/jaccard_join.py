"""Set-similarity join of documents by their word n-grams, with adaptive multi-match prefixes.

Exact copies share one node, the fingerprint of their set. All sets are ordered by one global order of tokens, rare ones first. Two sets that
are similar enough share at least one token among the first n - t + 1 of each, and at least l tokens among the first n - t + l, where t is the least overlap that the
threshold asks of a set of n tokens. Each set takes the l whose estimated cost, postings to read plus candidates to verify, is lowest;
a pair becomes a candidate with the smaller l of the two. Candidates are verified on their whole sets.

Only connectivity is asked for. In large buckets a few rounds of comparisons with one member each join what is near, and afterwards only
candidates between different components are formed, all of them; so a group of near copies doesn't give all its pairs, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _words
from ._components import components, gathered, kept
from ._spark import checkpointed

#: The share of all tokens, those of the lowest hashes, that are ordered by their frequency and stand before all others.
ORDERED = 0.3
MOST_MATCHES = 4
#: What verifying a candidate costs, in postings.
VERIFY_COST = 2.0
#: Tokens in at least this share of the texts, and of that many, stand behind the ordered ones; there are no more of them than
#: a text has tokens on average, by 1 / COMMON. A task reports tokens that reach the share among its own texts.
COMMON, COMMON_TEXTS = 0.001, 64
#: Buckets of more nodes are first joined by rounds, of which there are as many as it pays, up to ROUNDS, with PIVOTS comparisons a node,
#: as long as a round links at least LEAST_GAIN times the large buckets' postings.
LARGE_BUCKET, ROUNDS, PIVOTS, LEAST_GAIN = 32, 1, 3, 0.0005
#: A pair is formed where it shares a token, but for places where one of so many tokens before it is shared too.
EARLIER = 3
POSTINGS = ["token", "node", "n", "place", "level", "matches", *(f"earlier{i}" for i in range(1, EARLIER + 1))]
#: Rows of postings to a partition, and the least number of partitions of whole sets: few postings aren't spread over tasks that would mostly be empty.
PART_ROWS, SET_PARTS = 200_000, 8
#: Up to so many keys are broadcast; more are shuffled.
BROADCAST_IDS = 500_000
#: A group's center is the majority of up to so many of its members, three at least and of no more bytes otherwise; it goes to a group's rows in parts of so many
#: members. Which ones are taken changes costs only.
CENTER_OF, CENTER_BYTES, CENTER_ROWS = 48, 1 << 24, 2048
#: Tokens in so large a share of those members' deltas are frequent ones. Of the others' postings, about so many are brought together at once.
FREQUENT, DEALT_ROWS = 0.2, 500_000
#: A posting of a token in a delta.
DEALT = np.dtype([("token", np.int64), ("node", np.int64), ("component", np.int64), ("place", np.int32)])


def _least_overlap(n, num: int, den: int):
    """ceil(n * num / den)"""
    return (n * num + den - 1) // den


def shingles(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of every text, the second column."""
    at = 0
    for rows, data, offsets in _words.chunks(batch, 1):
        starts, before = _words.word_bounds(data, offsets, _words.BLANKS)
        hashes = _words.word_hashes(data, starts, _words.BLANKS)
        for i in range(rows.num_rows):
            yield at + i, np.unique(_words.ngrams(hashes[before[i] : before[i + 1]], n))
        at += rows.num_rows


def _node(tokens: np.ndarray) -> int:
    """A fingerprint of a set."""
    return int(_words.mixed(_words.mixed(tokens ^ _words.PLACES[9]).sum(keepdims=True) + np.full(1, len(tokens), np.uint64) * _words.PLACES[10]).view(np.int64)[0])


_LOW = np.uint64(int(ORDERED * 2.0**64))


def _fingerprints(n: int):
    """One row per text (id, key, n, node) and one per token that is common in this task (null, null, its count, token)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, seen = 0, np.empty(0, np.uint64)
        counts = np.empty(0, np.int64)
        for batch in batches:
            size, node, low = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), []
            for i, tokens in shingles(batch, n):
                if len(tokens):
                    size[i], node[i] = len(tokens), _node(tokens)
                    low.append(tokens[: np.searchsorted(tokens, _LOW)])
            yield _prints(batch.column(0), batch.column(2), size, node)
            if low:
                own, c = np.unique(np.concatenate(low), return_counts=True)
                keep = c > 1  # a token that is common in a task is in several texts of some batch, as batches hold many
                own, c = own[keep], c[keep]
                both, at = np.unique(np.concatenate([seen, own]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, c])).astype(np.int64) if len(both) else counts
                seen = both
            texts += batch.num_rows
        keep = counts >= max(2, texts * COMMON)
        none = pa.nulls(int(keep.sum()), pa.int64())
        yield _prints(none, none, counts[keep], seen[keep].view(np.int64), True)

    return run


def _prints(ids: pa.Array, keys: pa.Array, n: np.ndarray, node: np.ndarray, is_token: bool = False) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, keys, pa.array(n), pa.array(node), pa.array(np.full(len(n), is_token))], names=["id", "key", "n", "node", "is_token"])


def _postings(n: int, num: int, den: int, held):
    """(token, node, at) of the tokens that can stand in a prefix. at holds the number of ordered tokens and, for a token that isn't one, its place (in the upper half).

    Ordered are the tokens of the lowest hashes that aren't common; common ones follow, then all others. Copies within a task are read once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, met = held.value, set()
        out: list[tuple] = []
        total = 0
        for batch in batches:
            for _, tokens in shingles(batch, n):
                if not len(tokens) or (node := _node(tokens)) in met:
                    continue
                met.add(node)
                low = int(np.searchsorted(tokens, _LOW))
                if len(common):
                    at = np.minimum(np.searchsorted(common, tokens[:low]), len(common) - 1)
                    often = common[at] == tokens[:low]
                    if often.any():
                        tokens = np.concatenate([tokens[:low][~often], tokens[:low][often], tokens[low:]])
                        low -= int(often.sum())
                needs = _least_overlap(len(tokens), num, den)
                upto = max(low, len(tokens) - needs + min(MOST_MATCHES, needs))
                place = np.arange(1, upto + 1, dtype=np.int64)
                place[:low] = 0
                out.append((tokens[:upto].view(np.int64), np.full(upto, node), place << 32 | low))
                total += upto
                if total > 100_000:
                    yield _flat(out)
                    out, total = [], 0
        if out:
            yield _flat(out)

    return run


def _prefixes(num: int, den: int):
    """The prefix of each node (node, n, t): its tokens in the global order, cut for the number of matches that costs least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2)
            token, df, at = (rows.values.field(k).to_numpy() for k in range(3))
            starts = rows.offsets.to_numpy()
            out = []
            for i, (node, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                own = slice(starts[i], starts[i + 1])
                t, f, place, low = token[own], df[own], at[own] >> 32, int(at[own][0] & 0xFFFFFFFF)
                order = np.lexsort((t, f, place))
                t, f, place = t[order], f[order], place[order]
                ordered = int((place == 0).sum())
                # Ordered tokens that no other set has stand before these.
                place[:ordered] = low - ordered + 1 + np.arange(ordered)
                needs = _least_overlap(n, num, den)
                spare = n - needs
                ends = np.searchsorted(place, spare + np.arange(1, min(MOST_MATCHES, needs) + 1), "right")
                read = np.concatenate([[0.0], np.cumsum(f - 1.0)])[ends]
                matches = int(np.argmin(read * (1 + VERIFY_COST / np.arange(1, len(ends) + 1)))) + 1
                k = ends[matches - 1]
                if k:
                    # The tokens before each one; before the first, numbers that no other node has.
                    led = np.concatenate([np.int64(node) ^ np.arange(1, EARLIER + 1), t[:k]])
                    earlier = [led[EARLIER - i : EARLIER - i + k] for i in range(1, EARLIER + 1)]
                    out.append((t[:k], np.full(k, node), np.full(k, n), place[:k], np.maximum(1, place[:k] - spare), np.full(k, matches), *earlier))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], names=POSTINGS)

    return run


def _flat(parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["token", "node", "at"])


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, blob, held = [], [], 0
            for _, tokens in shingles(batch, n):
                if len(tokens):
                    node.append(_node(tokens))
                    blob.append(tokens.tobytes())
                    held += len(blob[-1])
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(blob, pa.binary())], names=["node", "tokens"])
                        node, blob, held = [], [], 0
            if node:
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(blob, pa.binary())], names=["node", "tokens"])

    return run


def _verified(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, left, right = batch.columns
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(left, right, strict=True)):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                both = int((x[at] == y).sum())
                keep[i] = den * both >= num * (len(x) + len(y) - both)
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], names=["u", "v"])

    return run


def _center(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the tokens that more than half of the sets have, tokens that several of them have or lack unlike that center, how many do)."""
    tokens, count = np.unique(np.concatenate(sets), return_counts=True)
    inside = 2 * count > len(sets)
    unlike = np.where(inside, len(sets) - count, count)
    return tokens[inside], tokens[unlike > 1], unlike[unlike > 1]


def _centers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pivot, sets) to (pivot, center, known, often, members)."""
    for batch in batches:
        rows = batch.column(1)
        out = [[], [], [], []]
        for sets in rows:
            own = [np.frombuffer(x.as_buffer(), np.uint64) for x in sets.values]
            for column, value in zip(out, (*(x.tobytes() for x in _center(own)), len(own)), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, (*[pa.binary()] * 3, pa.int64()), strict=True))], names=["pivot", "center", "known", "often", "members"])


def _deltas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, pivot, n, rare, delta): the tokens that a node's set and its group's center don't share, those first that are in few of the members' deltas; rare: how many aren't frequent."""
    for batch in batches:
        node, pivot, *sets, members = batch.columns
        n, rare, delta = [], [], []
        for *own, of in zip(*sets, members.to_pylist(), strict=True):
            tokens, center, known, often = (np.frombuffer(x.as_buffer(), t) for x, t in zip(own, (np.uint64, np.uint64, np.uint64, np.int64), strict=True))
            unlike = np.setxor1d(tokens, center, assume_unique=True)
            at = np.searchsorted(known, unlike)
            at[at == len(known)] = 0
            seen = np.where(known[at] == unlike, often[at], 0) if len(known) else np.zeros(len(unlike), np.int64)
            n.append(len(tokens))
            rare.append(int((seen < FREQUENT * of).sum()))
            delta.append(unlike[np.lexsort((unlike, seen))].view(np.int64))
        yield pa.RecordBatch.from_arrays([node, pivot, pa.array(n, pa.int64()), pa.array(rare, pa.int64()), pa.array(delta, pa.list_(pa.int64()))], names=["node", "pivot", "n", "rare", "delta"])


def _dealt(parts: int):
    """Postings (DEALT) of (node, pivot, component, rare, prefix) in blocks: a token of a group in the part of its hash; those behind the rare ones, which surely are several nodes', anywhere in parts of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(4)
            size = np.diff(tokens.offsets.to_numpy())
            token = tokens.flatten().to_numpy().view(np.uint64)
            node, pivot, component, rare = (np.repeat(batch.column(k).to_numpy(), size) for k in range(4))
            out = np.empty(len(token), DEALT)
            # A token is one group's: what two share by chance is told apart by the deltas.
            out["token"] = _words.mixed(token + pivot.view(np.uint64) * _words.PLACES[11]).view(np.int64)
            out["node"], out["component"] = node, component
            out["place"] = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size) + 1
            spread = np.where(out["place"] <= rare, out["token"], _words.mixed(node.view(np.uint64)).view(np.int64))
            part = (spread.view(np.uint64) % np.uint64(parts)).astype(np.int64) + parts * (out["place"] > rare)
            order = np.argsort(part, kind="stable")
            out, part = out[order], part[order]
            own, first = np.unique(part, return_index=True)
            blocks = [x.tobytes() for x in np.split(out, first[1:])] if len(own) else []
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(blocks, pa.binary())], names=["part", "block"])

    return run


def _met(parts: int):
    """The postings (DEALT) of tokens that nodes of different components have, from the blocks of one part after the other."""

    def some(blocks: list[bytes], part: int) -> pa.RecordBatch:
        rows = np.concatenate([np.frombuffer(x, DEALT) for x in blocks])
        if part < parts:
            rows = rows[np.lexsort((rows["component"], rows["token"]))]
            heads = np.flatnonzero(np.append(True, rows["token"][1:] != rows["token"][:-1]))
            ends = np.append(heads[1:], len(rows))
            rows = rows[np.repeat(rows["component"][heads] != rows["component"][ends - 1], ends - heads)]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[c])) for c in DEALT.names], names=list(DEALT.names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, blocks = -1, []
        for batch in batches:
            for part, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != last and blocks:
                    yield some(blocks, last)
                    blocks = []
                last = part
                blocks.append(block.as_buffer())
        if blocks:
            yield some(blocks, last)

    return run


class _Join:
    def __init__(self, docs: DataFrame, n: int, num: int, den: int) -> None:
        self.docs, self.n, self.num, self.den = docs, n, num, den
        # By its key a row is fetched again, with an id or without; repeated rows have one key.
        self.keyed = docs.withColumn("key", F.xxhash64("text_id", "text"))
        read = checkpointed(self.keyed.mapInArrow(_fingerprints(n), "id long, key long, n long, node long, is_token boolean"))
        self.prints = read.where("not is_token").drop("is_token")
        self.nodes = self.prints.where("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.min("key").alias("key"), F.first("n").alias("n"))
        least = max(COMMON_TEXTS, self.prints.count() * COMMON)
        common = read.where("is_token").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("node").collect()
        self.common = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r["node"] for r in common], np.int64).view(np.uint64)))

    def postings(self) -> DataFrame:
        """(POSTINGS, size): each node's prefix, in the buckets of its tokens of more than one node."""
        rows = self.docs.mapInArrow(_postings(self.n, self.num, self.den, self.common), "token long, node long, at long")
        # One shuffle by token serves the count and the merging of copies; no token is in more than a small share of the texts.
        shared = rows.withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1").dropDuplicates(["token", "node"])
        own = shared.groupBy("node").agg(F.collect_list(F.struct("token", "df", "at")).alias("t"))
        own = own.join(self.nodes.drop("least", "key"), "node").select("node", "n", "t")
        out = checkpointed(own.mapInArrow(_prefixes(self.num, self.den), ", ".join(f"{c} long" for c in POSTINGS)))
        # A token of one node only, known from its copies, leads to no pair.
        many = out.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
        return checkpointed(out.join(many, "token"))

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, tokens) of nodes (node), one row each, from the text of one row's key."""
        keys = nodes.join(self.nodes, "node").select("node", "key")
        keys = checkpointed(keys.join(self.prints.select("node", "key"), ["node", "key"]).groupBy("key").agg(F.count("*").alias("rows")))
        n_keys, most = keys.agg(F.count("*"), F.max("rows")).first()
        keys = keys.select("key")
        texts = self.keyed.join(F.broadcast(keys) if n_keys <= BROADCAST_IDS else keys, "key", "left_semi").select("text_id", "text")
        found = texts.mapInArrow(_sets(self.n), "node long, tokens binary").join(nodes, "node", "left_semi")
        # A node whose row is repeated is read from each copy.
        return found if (most or 0) <= 1 else found.dropDuplicates(["node"])

    def similar(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of pairs (u, v) of nodes whose sets are similar enough."""
        sides = [sets.select(F.col("node").alias(e), F.col("tokens").alias(f"{e}_tokens")) for e in "uv"]
        held = pairs.join(sides[0].hint("shuffle_hash"), "u").join(sides[1].hint("shuffle_hash"), "v")
        return checkpointed(held.select("u", "v", "u_tokens", "v_tokens").mapInArrow(_verified(self.num, self.den), "u long, v long").distinct())

    def meets(self, matches):
        """Whether a token at places up and vp of sets of un and vn tokens can be among the first ``matches`` that a similar pair shares.

        A similar pair shares at least o = ceil((un + vn) num / (num + den)) tokens, so these stand among the first n - o + matches of each set;
        and before and behind a shared token there is room for o - 1 others.
        """
        total, parts = (F.col("un") + F.col("vn")) * self.num, self.num + self.den
        in_prefix = lambda e: (F.col(f"{e}n") - F.col(f"{e}p") + matches) * parts >= total
        room = F.least("up", "vp") + F.least(F.col("un") - F.col("up"), F.col("vn") - F.col("vp"))
        return in_prefix("u") & in_prefix("v") & (room * parts >= total)

    def joined(self, large: DataFrame) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
        """(edges, labels, pivots) of large buckets: all links within the groups of pivots, and some others.

        A few rounds let nodes meet members of other components in their buckets. Then each node takes the head of a component that is the largest in most of its buckets as its
        pivot, and within() finds what the rounds have left among nodes of one pivot.
        """
        edges = labels = None
        n_large = large.count()
        if not n_large:
            return None, None, None
        parts = -(-n_large // PART_ROWS)
        large = kept(large, parts)
        sets = kept(checkpointed(self.sets(large.select("node").distinct())), max(parts, SET_PARTS))
        for k in range(ROUNDS):
            now = self.labelled(large, labels)
            split = now.groupBy("token", "component").agg(F.count("*").alias("c")).groupBy("token").agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("open"))
            if (split.agg(F.sum("open")).first()[0] or 0) <= 4 * n_large:
                break
            turn = F.xxhash64("token", "node", F.lit(k))
            pivot = now.groupBy("token").agg(F.min_by(F.struct(F.col("node").alias("v"), F.col("component").alias("vc"), F.col("n").alias("vn"), F.col("place").alias("vp")), turn).alias("p"))
            met = now.withColumnsRenamed({"n": "un", "place": "up"}).join(split.where("open > 0"), "token", "left_semi").join(pivot.select("token", "p.*"), "token").where((F.col("component") != F.col("vc")) & self.meets(F.lit(1)))
            # Of a node's pivots, those of the lowest hashes.
            turn = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("node", "v", F.lit(k))))
            few = met.select("node", "v").distinct().withColumn("turn", turn).where(F.col("turn") <= PIVOTS)
            found = self.similar(few.select(F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v")).distinct(), sets)
            n_found = found.count()
            if not n_found:
                break
            edges = found if edges is None else edges.union(found)
            labels = kept(components(edges), parts)
            if n_found < n_large * LEAST_GAIN:
                break
        now = self.labelled(large, labels)
        sizes = now.groupBy("token", "component").agg(F.count("*").alias("c"))
        heads = sizes.groupBy("token").agg(F.max_by("component", F.struct("c", "component")).alias("head"))
        votes = now.join(heads, "token").groupBy("node", "head").agg(F.count("*").alias("c"))
        pivots = votes.groupBy("node").agg(F.max_by("head", F.struct("c", "head")).alias("pivot"))
        many = pivots.groupBy("pivot").agg(F.count("*").alias("c")).where(F.col("c") > LARGE_BUCKET).select("pivot")
        pivots = kept(pivots.join(many, "pivot").select("node", "pivot"), parts)
        labels = kept(components(self.within(pivots, sets, labels, parts)), parts)
        return labels.select(F.col("node").alias("u"), F.col("component").alias("v")), labels, pivots

    def centers(self, pivots: DataFrame, sets: DataFrame) -> DataFrame:
        """(pivot, center, known, often, members) of every group."""
        order = Window.partitionBy("pivot").orderBy(F.xxhash64("node"), "node")
        few = pivots.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= CENTER_OF)
        own = sets.join(few, "node").withColumn("held", F.sum(F.octet_length("tokens")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        own = own.where((F.col("turn") <= 3) | (F.col("held") <= CENTER_BYTES)).groupBy("pivot").agg(F.collect_list("tokens").alias("sets"))
        return own.mapInArrow(_centers, "pivot long, center binary, known binary, often binary, members long")

    def within(self, pivots: DataFrame, sets: DataFrame, labels: DataFrame | None, parts: int) -> DataFrame:
        """Edges that connect what labels connect and all similar nodes of one pivot, by their deltas from the group's center.

        With d tokens of delta and f = (den + num) d - (den - num) n, two nodes are similar exactly if f + f' <= 2 (den + num) c for c shared tokens of delta. So whoever is similar
        without sharing any is so to the node of the lowest f too. The others share c tokens at least, which the first d - c + 1 of each, in one order, must show; only those are
        brought together, and only where nodes of different components meet. c is at least what the lowest f of another component asks, and, as c is no more than d',
        (f - (den - num) n') / (den + num) for the largest n' that can be similar.
        """
        both, less = self.num + self.den, self.den - self.num
        sizes = pivots.groupBy("pivot").agg(F.ceil(F.count("*") / CENTER_ROWS).alias("copies"))
        salted = sets.join(pivots.join(sizes, "pivot"), "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("copies"))).drop("copies")
        heads = self.centers(pivots, sets).join(sizes, "pivot").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        held = salted.join(heads, ["pivot", "salt"]).select("node", "pivot", "tokens", "center", "known", "often", "members")
        rows = held.mapInArrow(_deltas, "node long, pivot long, n long, rare long, delta array<long>")
        rows = kept(rows.withColumn("d", F.size("delta").cast("long")).withColumn("f", F.col("d") * both - F.col("n") * less), parts)
        lowest = rows.groupBy("pivot").agg(F.min(F.struct("f", "node")).alias("m")).select("pivot", F.col("m.f").alias("mf"), F.col("m.node").alias("m"))
        plain = rows.select("node", "pivot", "f").join(lowest, "pivot").where((F.col("f") + F.col("mf") <= 0) & (F.col("node") != F.col("m"))).select(F.col("node").alias("u"), F.col("m").alias("v"))
        plain = kept(plain if labels is None else plain.union(labels.select(F.col("node").alias("u"), F.col("component").alias("v"))), parts)
        labels = kept(components(plain), parts)
        placed = self.labelled(rows, labels)
        # The lowest f of a group, and the lowest one outside of that node's component.
        least = placed.groupBy("pivot", "component").agg(F.min("f").alias("f"))
        first = least.groupBy("pivot").agg(F.min(F.struct("f", "component")).alias("first"))
        second = least.join(first, "pivot").where(F.col("component") != F.col("first.component")).groupBy("pivot", "first").agg(F.min("f").alias("second"))
        placed = placed.join(second, "pivot").withColumn("other", F.when(F.col("component") == F.col("first.component"), F.col("second")).otherwise(F.col("first.f")))
        asked = lambda f, g: F.greatest(F.lit(1), F.ceil((f + g) / (2 * both)))
        needs = F.greatest(asked(F.col("f"), F.col("other")), F.ceil((F.col("f") * self.num - F.col("n") * less * self.den) / (self.num * both)))
        length = (F.col("d") - needs + 1).cast("int")
        able = placed.where(length > 0)
        prefixes = able.select("node", "pivot", "component", "rare", F.slice("delta", F.lit(1), length).alias("prefix"))
        n_tokens = able.agg(F.sum(F.least(length, F.col("d")))).first()[0]
        if not n_tokens:
            return labels.select(F.col("node").alias("u"), F.col("component").alias("v"))
        deals = max(parts, -(-n_tokens // DEALT_ROWS))
        blocks = gathered(prefixes.mapInArrow(_dealt(deals), "part long, block binary"), 1 if deals == 1 else None)
        blocks = blocks.sortWithinPartitions("part") if deals == 1 else blocks.repartition("part").sortWithinPartitions("part")
        found = blocks.mapInArrow(_met(deals), "token long, node long, component long, place int")
        tokens = kept(found.join(rows.select("node", "d", "f"), "node"), parts)
        sides = [tokens.select("token", *(F.col(c).alias(e if c == "node" else f"{e}_{c}") for c in ("node", "component", "place", "d", "f"))) for e in "uv"]
        share = asked(F.col("u_f"), F.col("v_f"))
        met = sides[0].join(sides[1], "token").where((F.col("u") > F.col("v")) & (F.col("u_component") != F.col("v_component")) & (F.col("u_place") <= F.col("u_d") - share + 1) & (F.col("v_place") <= F.col("v_d") - share + 1))
        pairs = met.select("u", "v", "u_component", "v_component").distinct()
        held = pairs.join(rows.select(F.col("node").alias("u"), F.col("delta").alias("ud"), F.col("f").alias("uf")), "u").join(rows.select(F.col("node").alias("v"), F.col("delta").alias("vd"), F.col("f").alias("vf")), "v")
        shared = held.where(F.col("uf") + F.col("vf") <= 2 * both * F.size(F.array_intersect("ud", "vd"))).select("u_component", "v_component").distinct()
        return kept(labels.select("node", "component").union(shared).toDF("u", "v"), parts)

    def links(self) -> DataFrame:
        """Edges (u, v) that connect exactly the nodes that similar pairs connect."""
        postings = self.postings()
        parts = max(1, -(-postings.count() // PART_ROWS))
        postings = gathered(postings, parts)
        edges, labels, pivots = self.joined(postings.where(F.col("size") > LARGE_BUCKET).select("token", "node", "n", "place"))
        now = self.labelled(postings, labels)
        if pivots is not None:
            # Nodes of one pivot have met already.
            now = now.join(pivots, "node", "left").withColumn("component", F.when(F.col("pivot").isNotNull(), F.xxhash64(F.lit("pivot"), "pivot")).otherwise(F.col("component"))).drop("pivot")
        now = kept(now, parts)
        # In a bucket, all but the largest component meet every other component; pairs within the largest are connected already.
        sizes = now.groupBy("token", "component").agg(F.count("*").alias("c"))
        main = sizes.groupBy("token").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
        all_ = now.join(main, "token")
        names = {"node": "", "component": "c", "n": "n", "place": "p", "matches": "m"} | {f"earlier{i}": f"e{i}" for i in range(1, EARLIER + 1)}
        minor = all_.where("component <> main").select("token", *(F.col(c).alias(f"u{x}") for c, x in names.items()))
        other = all_.select("token", *(F.col(c).alias(f"v{x}") for c, x in names.items()), (F.col("component") == F.col("main")).alias("is_main"))
        again = reduce(Column.__or__, (F.col(f"ue{i}") == F.col(f"ve{j}") for i in range(1, EARLIER + 1) for j in range(1, EARLIER + 1)))
        asked = F.least("um", "vm")
        met = minor.join(other, "token").where((F.col("uc") != F.col("vc")) & (F.col("is_main") | (F.col("u") < F.col("v"))) & self.meets(asked) & ~again)
        pairs = met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), asked.alias("asked")).distinct()
        # The number of shared tokens decides what is verified.
        prefix = all_.groupBy("node").agg(F.collect_list(F.struct("level", "token")).alias("t"))
        held = pairs.join(prefix.select(F.col("node").alias("u"), F.col("t").alias("ut")), "u").join(prefix.select(F.col("node").alias("v"), F.col("t").alias("vt")), "v")
        first = [F.transform(F.filter(t, lambda x: x["level"] <= F.col("asked")), lambda x: x["token"]) for t in ("ut", "vt")]
        pairs = kept(held.where(F.size(F.array_intersect(*first)) >= F.col("asked")).select("u", "v"), parts)
        sets = self.sets(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
        found = self.similar(pairs, sets)
        return found if edges is None else edges.union(found)

    @staticmethod
    def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return rows.withColumn("component", F.col("node"))
        return rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs.

    A text, A-Z as a-z, is the set of its distinct n-grams of ``words`` words (runs without ASCII blanks); with fewer words, all of them as one. Rows are linked when
    den * intersection >= num * union for ``similarity`` num/den; component_id is the smallest id reachable by links. Null and empty texts and texts without words have no n-gram, no link
    and their own id as component. Repeated rows are copies of each other; a row with a null id takes part, and the component of rows with null ids only is null.
    Further columns are ignored; an empty table gives an empty result. N-grams and sets are compared by 64-bit hashes.
    """
    num, den = similarity
    rows = docs.select(F.col(id_col).cast("long").alias("text_id"), F.col(text_col).alias("text"))
    join = _Join(rows, words, num, den)
    found = checkpointed(components(join.links()))
    ids = found.join(join.nodes, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    placed = found.join(ids, "component").select("node", "component_id")
    labelled = join.nodes.select("node", "least").join(placed, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    full = join.prints.where("n > 0").join(labelled, "node").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(join.prints.where("n = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
