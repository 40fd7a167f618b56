"""Byte-level BPE encoding and decoding in linear time.

The bytes of a piece are read as Latin-1 characters, over which an Aho-Corasick automaton of the vocabulary gives longest matches.
A sequence of tokens is the BPE result exactly if every two neighbours are compatible, that is if merging their joined bytes gives
the two back. So the longest matches are taken from left to right, each pair is looked up in a memo of compatible pairs, and where
a pair is not compatible the encoder goes on with shorter tokens, or one token back.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Bounds of what a Python worker keeps: pieces with their ids, and pairs of tokens. Both start anew when full.
CACHED_PIECES, CACHED_PAIRS, CACHED_LENGTH = 400_000, 400_000, 48
#: Texts of more characters are split into pieces bit by bit.
LONG_TEXT, PIECES_AT_ONCE = 1 << 20, 1 << 16
BATCH_BYTES = 4 << 20


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The merges of the definition, lowest rank first, for short strings only: it takes quadratic time."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min((r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], len(ranks) * 2)) >= 0)
        if best[0] == len(ranks) * 2:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@functools.lru_cache(maxsize=4)
def load(path: str) -> tuple[dict[bytes, int], frozenset[bytes]]:
    """(ranks, tokens that merging can reach) of a rank file; a file holds a vocabulary, some hundred thousand lines at most."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    if absent := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"{path} has no token for the bytes {absent}")
    return ranks, frozenset(t for t in ranks if len(t) == 1 or merged(t, ranks) == [t])


class Encoder(dict):
    """Maps a piece of text to its packed ids (little-endian unsigned 32-bit integers); remembers short pieces."""

    def __init__(self, ranks: dict[bytes, int], reachable: frozenset[bytes]) -> None:
        import ahocorasick

        super().__init__()
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.packed = {r: r.to_bytes(4, "little") for r in ranks.values()}
        self.length_of = {r: len(t) for t, r in ranks.items()}
        self.shorter: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.reachable = reachable
        self.longest = ahocorasick.Automaton()
        for token in reachable:
            self.longest.add_word(token.decode("latin-1"), ranks[token])
        self.longest.make_automaton()

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        packed = self.packed
        ids = packed[whole] if whole is not None else b"".join([packed[token] for token in self.split(raw.decode("latin-1"))])
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            x, y = self.bytes_of[a], self.bytes_of[b]
            found = self.pairs[key] = merged(x + y, self.ranks) == [x, y]
        return found

    def prefix(self, token: int) -> int:
        """The next shorter token that this one starts with, or -1."""
        found = self.shorter.get(token)
        if found is None:
            t = self.bytes_of[token]
            found = self.shorter[token] = next((self.ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.reachable), -1)
        return found

    def split(self, text: str) -> list[int]:
        """The tokens of a piece that is no token itself, in Latin-1."""
        out, at, pairs = [], 0, self.pairs
        last = -1
        for end, token in self.longest.iter_long(text):
            if last >= 0:
                fits = pairs.get(last << 32 | token)
                if not (self.fits(last, token) if fits is None else fits):
                    return self.backtrack(text, out, at, token)
            out.append(token)
            at, last = end + 1, token
        return out

    def backtrack(self, text: str, out: list[int], at: int, token: int) -> list[int]:
        """Goes on from the tokens ``out`` of text[:at] where ``token``, the longest there, doesn't fit."""
        end, pairs, shorter, length_of, longest = len(text), self.pairs, self.shorter, self.length_of, self.longest.iter_long
        dead = set()  # positions from which no way led on
        while True:
            after = at + length_of[token]
            if after not in dead:
                if out:
                    fits = pairs.get(out[-1] << 32 | token)
                    if fits is None:
                        fits = self.fits(out[-1], token)
                else:
                    fits = True
                if fits:
                    out.append(token)
                    at = after
                    if at == end:
                        return out
                    token = next(longest(text, at))[1]
                    continue
            less = shorter.get(token)
            if less is None:
                less = self.prefix(token)
            if less >= 0:
                token = less
            else:
                dead.add(at)
                token = out.pop()
                at -= length_of[token]


def encode_text(text: str, pattern: regex.Pattern, encoder: Encoder) -> bytes:
    if len(text) <= LONG_TEXT:
        return b"".join(map(encoder.__getitem__, pattern.findall(text)))
    pieces = (m.group() for m in pattern.finditer(text))
    return b"".join(iter(lambda: b"".join(map(encoder.__getitem__, islice(pieces, PIECES_AT_ONCE))), b""))


_ENCODERS: dict[int, Encoder] = {}


def _with_columns(batches: Iterable[pa.RecordBatch], source: int, made, names: list[str], keep: list[int]) -> Iterator[pa.RecordBatch]:
    """Batches with more binary columns, made(value) for each row, cut so that the new values of a batch stay near BATCH_BYTES."""
    for batch in batches:
        column, start = batch.column(source), 0
        held: list[tuple[bytes, ...]] = []
        size = 0
        for i in range(batch.num_rows):
            held.append(values := made(column[i].as_py()))
            size += sum(map(len, values))
            if size >= BATCH_BYTES or i == batch.num_rows - 1:
                rows = batch.slice(start, len(held))
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in keep), *(pa.array(c, pa.binary()) for c in zip(*held, strict=True))], names=[*(batch.schema.names[k] for k in keep), *names])
                start, held, size = i + 1, [], 0


def _mapped(df: DataFrame, source: str, names: list[str], keep_cols: list[str] | None, maker) -> DataFrame:
    from pyspark.sql.types import BinaryType, StructField, StructType

    new = {n.lower() for n in names}
    keep = [i for i, c in enumerate(df.columns) if c.lower() not in new and (keep_cols is None or c in keep_cols)]
    at = df.columns.index(source)
    schema = StructType([*(df.schema.fields[i] for i in keep), *(StructField(n, BinaryType()) for n in names)])
    return df.mapInArrow(lambda batches: _with_columns(batches, at, maker(), names, keep), schema)


def _decoded(ids: bytes, bytes_of: dict[int, bytes]) -> bytes:
    return b"".join(map(bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(df: DataFrame, *, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """df, or its columns ``keep``, with ``ids_col``: the token ids of the whole text, packed as little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is encoded by itself, without special tokens; a piece that is a token is that token. Null text counts as empty and has no ids.
    bytes_col: also a column with what the ids decode to, from the same pass. Rows stay as they are, repeated ones too; columns of the new names
    are replaced; an empty table stays empty.
    """
    ranks = df.sparkSession.sparkContext.broadcast(load(path))  # a vocabulary: bounded by its file

    def maker():
        key = id(ranks.value)
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(*ranks.value)
        encoder, compiled = _ENCODERS[key], regex.compile(pattern)

        def made(text: str | None) -> tuple[bytes, ...]:
            ids = encode_text(text or "", compiled, encoder)
            return (ids,) if bytes_col is None else (ids, _decoded(ids, encoder.bytes_of))

        return made

    return _mapped(df, text_col, [ids_col] if bytes_col is None else [ids_col, bytes_col], keep, maker)


def decode(df: DataFrame, *, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """df with ``bytes_col``: the bytes that packed ids stand for. Null ids give no bytes; an id that isn't in the vocabulary raises."""
    ranks = df.sparkSession.sparkContext.broadcast(load(path)[0])

    def maker():
        of = {r: t for t, r in ranks.value.items()}
        return lambda ids: (_decoded(ids or b"", of),)

    return _mapped(df, ids_col, [bytes_col], None, maker)
