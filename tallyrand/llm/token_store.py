"""Token ids in wavelet matrices.

Documents are dealt by ranges of their ids to shards. A shard's ids, in that order, are cut into segments, and each segment is one wavelet matrix: a plane of bits for each binary
digit of an id, highest first, every plane partitioned stably by the one before. With the number of ones before each block of BLOCK bits a plane answers rank and select, so a segment
gives single ids, counts and places of an id without being decoded. The file format is Parquet, compressed by Zstandard, with one row for each segment.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bits to a block, ids after which a segment ends with the document, pieces of text that an encoder remembers twice, bytes that are encoded together, bytes of text to a shard, and shards at most.
BLOCK, SEGMENT, REMEMBERED, GROUP, SHARD_BYTES, SHARDS = 512, 1 << 20, 300_000, 1 << 23, 1 << 24, 100_000
SCHEMA = "shard int, segment int, start long, n int, bits int, zeros array<int>, planes binary, ranks binary, doc_ids array<long>, doc_starts array<int>"


def ragged(flat: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of the lists ``index`` of those that lie in ``flat`` one behind the other."""
    begins, own = np.cumsum(sizes) - sizes, sizes[index]
    return flat[np.arange(own.sum()) + np.repeat(begins[index] - (np.cumsum(own) - own), own)], own


class Encoder:
    """Ids of whole texts by the tokenizers library. No token of the given file spans a blank or line feed, or a letter or digit of ASCII and a sign behind it, so the pieces between these are encoded once and remembered while they recur.

    Pieces of letters only are encoded many at a time and told apart by the tokens that end a word.
    """

    #: Signs that may end a chunk; apostrophes begin tokens with letters, and special tokens are made of <, | and >.
    SIGNS = ",.;:!?$#%&*()-_=+[]{}/\\@^~\"`"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.wide = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _separate(self, pieces: Sequence[str]) -> list[bytes]:
        return [np.array(x.ids, self.wide).tobytes() for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _words(self, words: Sequence[str]) -> list[bytes]:
        if len(words) == 1:
            return self._separate(words)
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, self.wide)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):  # some letters become others and signs
            return self._words(words[: len(words) // 2]) + self._words(words[len(words) // 2 :])
        data, size = ids.tobytes(), self.wide.itemsize
        ends = (ends * size).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _pieces(self, chunks: pa.Array) -> tuple[list[str], np.ndarray]:
        """(different pieces, two of them for every chunk): what stands before a chunk's last signs, and these, which may be empty."""
        piece = pc.utf8_rtrim(chunks, self.SIGNS)
        letters = pc.utf8_is_alpha(piece)
        piece = pc.if_else(pc.or_(letters, pc.match_substring_regex(piece, "[0-9A-Za-z]$")), piece, chunks)
        piece = pc.if_else(letters, pc.ascii_lower(piece), piece).dictionary_encode()
        own = piece.dictionary.to_pylist()
        rest = pc.subtract(pc.binary_length(chunks), pc.binary_length(piece.cast(chunks.type))).to_numpy(zero_copy_only=False)  # signs are of one byte
        some = np.flatnonzero(rest)
        tails: dict[str, int] = {"": len(own)}
        second = np.full(len(chunks), len(own))
        second[some] = [tails.setdefault(chunk[-size:], len(own) + len(tails)) for chunk, size in zip(chunks.take(pa.array(some)).to_pylist(), rest[some].tolist(), strict=True)]
        return [*own, *tails], np.column_stack([piece.indices.to_numpy(zero_copy_only=False).astype(np.int64), second])

    def _learn(self, pieces: Sequence[str]) -> None:
        own, before = self.known, self.before
        new = set(pieces).difference(own)
        own.update((p, before[p]) for p in new if p in before)
        new = [p for p in new if p not in own]
        for some, encode, most in (([p for p in new if p.isalpha()], self._words, 256), ([p for p in new if not p.isalpha()], self._separate, 4096)):
            for at in range(0, len(some), most):
                own.update(zip(some[at : at + most], encode(some[at : at + most]), strict=True))

    def __call__(self, texts: pa.Array | Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts in a row, how many each text has)."""
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        chunks = split.flatten().dictionary_encode()
        pieces, pairs = self._pieces(chunks.dictionary)
        self._learn(pieces)
        found = [self.known[p] for p in pieces]
        own = np.frombuffer(b"".join(found), self.wide), np.fromiter(map(len, found), np.int64, len(found)) // self.wide.itemsize
        own, sizes = ragged(*own, pairs.ravel())
        ids, sizes = ragged(own, sizes.reshape(-1, 2).sum(1), chunks.indices.to_numpy(zero_copy_only=False).astype(np.int64))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy())])]
        return ids, np.diff(ends)


@functools.cache
def encoder(path: str) -> Encoder:
    """A Python worker's encoder, kept from task to task."""
    return Encoder(path)


@dataclass(frozen=True)
class WaveletMatrix:
    """planes: (bits, blocks, BLOCK / 64) words of 64 bits, the lowest bit first; ranks: ones before each block, (bits, blocks + 1); zeros: zeros of each plane."""

    n: int
    zeros: tuple[int, ...]
    planes: np.ndarray
    ranks: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        n, blocks = len(ids), -(-len(ids) // BLOCK)
        planes, zeros = np.zeros((bits, blocks * BLOCK // 8), np.uint8), []
        rest = np.ascontiguousarray(ids)
        for k in range(bits):
            one = (rest >> rest.dtype.type(bits - 1 - k)) & rest.dtype.type(1) != 0
            packed = np.packbits(one, bitorder="little")
            planes[k, : len(packed)] = packed
            low = rest[~one]
            zeros.append(len(low))
            rest = np.concatenate([low, rest[one]])
        words = planes.view("<u8").reshape(bits, blocks, BLOCK // 64)
        ranks = np.zeros((bits, blocks + 1), "<u4")
        np.cumsum(np.bitwise_count(words).sum(2, dtype=np.uint32), axis=1, out=ranks[:, 1:])
        return cls(n, tuple(zeros), words, ranks)

    @classmethod
    def from_bytes(cls, n: int, zeros: Sequence[int], planes: bytes, ranks: bytes) -> WaveletMatrix:
        bits = len(zeros)
        return cls(n, tuple(zeros), np.frombuffer(planes, "<u8").reshape(bits, -1, BLOCK // 64), np.frombuffer(ranks, "<u4").reshape(bits, -1))

    def _ones(self, k: int) -> np.ndarray:
        return np.unpackbits(self.planes[k].reshape(-1).view(np.uint8), count=self.n, bitorder="little").view(bool)

    def decoded(self) -> np.ndarray:
        """All ids in order: the planes' partitions undone from the last to the first."""
        ids = np.zeros(self.n, np.uint32)
        for k in reversed(range(len(self.zeros))):
            one, z = self._ones(k), self.zeros[k]
            before = np.empty_like(ids)
            before[~one] = ids[:z]
            before[one] = ids[z:] | np.uint32(1 << (len(self.zeros) - 1 - k))
            ids = before
        return ids

    def rank(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones of plane k before each place of ``at``."""
        block = np.minimum(at // BLOCK, self.planes.shape[1] - 1)
        inside = at - block * BLOCK
        left = np.clip(inside[:, None] - np.arange(0, BLOCK, 64)[None], 0, 64).astype(np.uint64)
        mask = np.where(left == 64, ~np.uint64(0), (np.uint64(1) << (left & np.uint64(63))) - np.uint64(1))
        return self.ranks[k][block].astype(np.int64) + np.bitwise_count(self.planes[k][block] & mask).sum(1, dtype=np.int64)

    def select(self, k: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """The place of the nth (from 0) such bit of plane k."""
        ends = self.ranks[k].astype(np.int64) if bit else np.arange(self.ranks.shape[1]) * BLOCK - self.ranks[k]
        block = np.searchsorted(ends, nth, "right") - 1
        bits = np.unpackbits(self.planes[k][block].view(np.uint8), axis=1, bitorder="little") == bit
        return block * BLOCK + (np.cumsum(bits, 1) > (nth - ends[block])[:, None]).argmax(1)

    def access(self, at: Sequence[int] | np.ndarray) -> np.ndarray:
        """The ids at these places."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.uint32)
        for k in range(len(self.zeros)):
            before = self.rank(k, at)
            one = self.rank(k, at + 1) > before
            out = (out << np.uint32(1)) | one
            at = np.where(one, self.zeros[k] + before, at - before)
        return out

    def interval(self, token: int, end: int | None = None) -> tuple[int, int]:
        """Where the token's occurrences before ``end`` lie behind the last plane."""
        span = np.array([0, self.n if end is None else end], np.int64)
        if not 0 <= token < 1 << len(self.zeros):
            return 0, 0
        for k, z in enumerate(self.zeros):
            before = self.rank(k, span)
            span = z + before if token >> (len(self.zeros) - 1 - k) & 1 else span - before
        return int(span[0]), int(span[1])

    def count(self, token: int, end: int | None = None) -> int:
        first, last = self.interval(token, end)
        return last - first

    def places(self, token: int) -> np.ndarray:
        """All places of a token, ascending, found upwards by select."""
        first, last = self.interval(token)
        at = np.arange(first, last)
        for k in reversed(range(len(self.zeros))):
            bit = token >> (len(self.zeros) - 1 - k) & 1
            at = self.select(k, bit, at - self.zeros[k] * bit) if len(at) else at
        return at


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch's rows (shard, id, text), about GROUP bytes of text at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        to = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + GROUP, "right")))
        yield batch.slice(start, to - start)
        start = to


def write(docs: DataFrame, out: str, *, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2) -> None:
    """Writes the token ids of every whole text, each document's followed by ``end_id``, to the folder ``out``, in ascending order of id_col (long), in wavelet matrices.

    ``path``: a file of the tokenizers library whose tokens hold no blank. Null and empty texts have the end id only (and, without one, no id). Rows with a null id come first; rows of
    one id stay apart, in an order that depends on their texts. Other columns may have any name; an empty table gives a folder without rows.

    Memory: a task holds a segment, that is SEGMENT ids and the document with which it ends. Shards are cut by sampled ranges of (id, hash of the text), so neither many rows of an id nor large documents make one task's work grow.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(min(SHARDS, size // SHARD_BYTES + 1), *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("shard"), "id", "text")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        vocabulary = max(encode.tokenizer.get_vocab_size(), (end_id or 0) + 1)
        bits, end = max(1, (vocabulary - 1).bit_length()), np.array([] if end_id is None else [end_id], encode.wide)
        parts, ids, starts, n, start, shard, segment = [], [], [], 0, 0, 0, 0

        def ended() -> pa.RecordBatch:
            matrix = WaveletMatrix.of(np.concatenate(parts), bits)
            values = [[shard], [segment], [start], [n], [bits], [list(matrix.zeros)], [matrix.planes.tobytes()], [matrix.ranks.tobytes()], [ids], [starts]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for rows in _groups(batch):
                shard = rows.column(0)[0].as_py()
                flat, sizes = encode(rows.column(2))
                for key, found in zip(rows.column(1).to_pylist(), np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
                    ids.append(key)
                    starts.append(n)
                    parts += [found, end]
                    n += len(found) + len(end)
                    if n >= SEGMENT:
                        yield ended()
                        parts, ids, starts, start, segment, n = [], [], [], start + n, segment + 1, 0
        if ids:
            yield ended()

    dealt.mapInArrow(packed, SCHEMA).write.option("compression", "zstd").parquet(out)


def _segments(spark: SparkSession, out: str) -> DataFrame:
    """The segments' rows with base, the ids of all shards before. One row for each shard, SHARDS at most, is ordered and broadcast."""
    rows = spark.read.parquet(out)
    shards = rows.groupBy("shard").agg(F.sum("n").cast("long").alias("n"))
    base = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return rows.join(F.broadcast(base), "shard")


def _mapped(spark: SparkSession, out: str, schema: str, each) -> DataFrame:
    """The columns that each(matrix, base, ids, starts) gives for every segment; base: ids of all documents before the segment."""
    names = [c.split()[0] for c in schema.split(", ")]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = [c[k].as_py() for c in batch.columns]
                columns = each(WaveletMatrix.from_bytes(row[0], row[1], row[2], row[3]), row[4], row[5], np.array(row[6], np.int64))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = _segments(spark, out).select("n", "zeros", "planes", "ranks", (F.col("base") + F.col("start")).alias("at"), "doc_ids", "doc_starts")
    return rows.mapInArrow(judged, schema)


def read(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a written folder; start: ids of all documents before it; ids: little-endian unsigned 32-bit integers."""

    def each(matrix: WaveletMatrix, base: int, ids: list, starts: np.ndarray) -> list[pa.Array]:
        data, ends = matrix.decoded().astype("<u4"), np.append(starts[1:], matrix.n)
        return [pa.array(ids, pa.int64()), pa.array(base + starts), pa.array(ends - starts), pa.array([data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())]

    return _mapped(spark, out, "doc_id long, start long, n_tokens long, ids binary", each)


def counts(spark: SparkSession, out: str, tokens: Sequence[int]) -> DataFrame:
    """(token, n) of each given token over the whole folder, by rank; nothing is decoded."""
    tokens = sorted(set(tokens))

    def each(matrix: WaveletMatrix, base: int, ids: list, starts: np.ndarray) -> list[pa.Array]:
        return [pa.array(tokens, pa.int64()), pa.array([matrix.count(t) for t in tokens], pa.int64())]

    return _mapped(spark, out, "token long, n long", each).groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, out: str, tokens: Sequence[int]) -> DataFrame:
    """(token, doc_id, place, at) of every occurrence of the given tokens, by select; place: in its document, at: in the whole folder."""
    tokens = sorted(set(tokens))

    def each(matrix: WaveletMatrix, base: int, ids: list, starts: np.ndarray) -> list[pa.Array]:
        found = [matrix.places(t) for t in tokens]
        at = np.concatenate([np.empty(0, np.int64), *found]).astype(np.int64)
        doc = np.searchsorted(starts, at, "right") - 1
        return [pa.array(np.repeat(np.array(tokens, np.int64), [len(f) for f in found])), pa.array([ids[d] for d in doc], pa.int64()), pa.array(at - starts[doc] if len(at) else at), pa.array(base + at)]

    return _mapped(spark, out, "token long, doc_id long, place long, at long", each)


def tokens_at(spark: SparkSession, out: str, places: Sequence[int]) -> DataFrame:
    """(at, token) of given places in the whole folder, by access; places behind the end give no row."""
    wanted = np.unique(np.asarray(places, np.int64))

    def each(matrix: WaveletMatrix, base: int, ids: list, starts: np.ndarray) -> list[pa.Array]:
        own = wanted[(wanted >= base) & (wanted < base + matrix.n)]
        return [pa.array(own), pa.array(matrix.access(own - base).astype(np.int64))]

    return _mapped(spark, out, "at long, token long", each)
