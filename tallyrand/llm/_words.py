"""Hashes of words and word n-grams, over the bytes of whole Arrow batches at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
#: Odd factors for the places of a word's bytes. They are drawn, not powers of one number: such sums agree for some texts by construction. Behind the last of them each begins anew with a factor of its round.
_PLACE = _RNG.integers(1, 2**63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Odd factors for the places of an n-gram.
PLACES = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The bytes that part words: the blanks of ASCII; and all of ASCII but letters and digits.
BLANKS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
SIGNS = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])
BLOCK, CHUNK = 1 << 19, 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of their texts, offsets of the texts in those bytes), about CHUNK bytes at a time; null texts are empty."""
    text = batch.column(column)
    if not len(text):
        return
    wide = pa.types.is_large_string(text.type)
    offsets = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    if text.null_count:  # the bytes under a null are undefined
        lengths = np.where(text.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        if (lengths != np.diff(offsets)).any():
            text = text.fill_null("")
            offsets = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        to = min(to, len(text))
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray, parting: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of every word, number of words before each text and in all)."""
    inside = ~parting[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    return starts, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, parting: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, alike for A-Z and a-z."""
    table = np.where(parting, np.uint64(0), _BYTE)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + BLOCK)))
        end = starts[to] if to < len(starts) else len(data)
        own = starts[at:to] - starts[at]
        place = np.arange(end - starts[at]) - np.repeat(own, np.diff(np.append(own, end - starts[at])))
        terms = table[data[starts[at] : end]] * _PLACE[place & (len(_PLACE) - 1)]
        far = np.flatnonzero(place >= len(_PLACE))
        if len(far):
            terms[far] *= mixed((place[far] // len(_PLACE)).astype(np.uint64)) | np.uint64(1)
        out[at:to] = np.add.reduceat(terms, own)
        at = to
    return mixed(out)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words in a row; of all words as one where there are fewer; empty without words."""
    if not len(words):
        return words
    k = min(n, len(words))
    total = words[: len(words) - k + 1] * PLACES[0]
    for i in range(1, k):
        total = total + words[i : len(words) - k + 1 + i] * PLACES[i]
    return mixed(total + np.uint64(k))
