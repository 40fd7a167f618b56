"""Spelling variants: words one edit apart, found in errata tries.

Words that share their first letters form a trie; a node is a range of the sorted words with its depth, so paths without a branch cost nothing. At a branch the largest child
continues the heavy path, and the subtrees of all others, the light ones, are merged: with the branching letter replaced by any, their terminals are keyed by what follows it and looked up
under the heavy child; with a letter skipped they are looked up under the branch itself. Coinciding terminals are one edit apart. A word is light at most log2(words) times, so the
work is that many look-ups a word.

An edit leaves the first SHARED letters of a word or its last ones, so tries of words by their first letters and of reversed words by their last ones hold every pair. A pair is counted
where its common prefix says, once. Shards that are too large for a task are split by their next letter; the edits at that letter are found by a shuffle on what the words are without it.
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import BROADCAST_KEYS, checkpointed

#: Letters that key a trie; words to a task's trie at most, beyond which it is split.
SHARED, SHARD_WORDS = 3, 10_000
FOUND = "word string, n_near long, form_n long, form string"


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", letters: str = r"a-zÀ-ÿ", change: Callable[[Column, Column], Column] | None = None, least_chars: int = 7, least_n: int = 2) -> DataFrame:
    """(word, n): the maximal runs of ``letters`` in the whole texts, A-Z lower-cased, that have ``least_chars`` code points or more and occur ``least_n`` times or more.

    ``change``: gives what a run counts as, from its document's id and itself, never longer than the run; null leaves it. Null and empty texts have no words; every row of docs counts, repeated ones too; other columns may have any name.
    """
    upper = "".join(map(chr, range(65, 91)))
    runs = F.regexp_extract_all(F.translate(F.col(text_col), upper, upper.lower()), F.lit(f"[{letters}]{{{least_chars},}}"), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("word"))
    if change:
        rows = rows.select(F.coalesce(change(F.col("id"), F.col("word")), F.col("word")).alias("word")).where(F.length("word") >= least_chars)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


class Tally:
    """For each of some words: how many of the others are near, and the most frequent of these, of equals the first."""

    def __init__(self, words: Sequence[str], ns: Sequence[int]):
        self.words, self.ns = words, ns
        self.near = [0] * len(words)
        self.best: list[int | None] = [None] * len(words)

    def order(self, i: int) -> tuple[int, str]:
        return -self.ns[i], self.words[i]

    def offer(self, i: int, j: int) -> None:
        held = self.best[i]
        if held is None or self.order(j) < self.order(held):
            self.best[i] = j

    def pair(self, i: int, j: int) -> None:
        self.near[i] += 1
        self.near[j] += 1
        self.offer(i, j)
        self.offer(j, i)

    def group(self, own: Sequence[int]) -> None:
        """All of these are near each other."""
        first, second = sorted(own, key=self.order)[:2]
        for i in own:
            self.near[i] += len(own) - 1
            self.offer(i, second if i == first else first)

    def batch(self) -> pa.RecordBatch:
        rows = [(self.words[i], k, self.ns[self.best[i]], self.words[self.best[i]]) for i, k in enumerate(self.near) if k]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "form_n", "form"])


def owned(a: str, b: str, backward: bool) -> bool:
    """Whether a trie counts this pair, both as spelt in it: reversed ones do where the words' first SHARED letters differ."""
    return not backward or a[-SHARED:] != b[-SHARED:]


def meet(words: Sequence[str], depth: int, backward: bool, tally: Tally) -> None:
    """Counts the pairs of a trie that branch at ``depth`` or deeper. words: sorted, as spelt in the trie, sharing their first ``depth`` letters."""
    index = {w: i for i, w in enumerate(words)}
    rest_most = SHARED - 1 if backward else max(map(len, words), default=0)  # a pair that shares more behind the edit isn't owned
    stack = [(0, len(words))]
    while stack:
        lo, hi = stack.pop()
        if hi - lo < 2:
            continue
        prefix = os.path.commonprefix((words[lo], words[hi - 1]))
        at, children, begin = len(prefix), [], lo
        terminal = lo if len(words[lo]) == at else None
        begin += terminal is not None
        while begin < hi:
            letter = words[begin][at]
            end = bisect.bisect_left(words, prefix + chr(ord(letter) + 1), begin, hi) if ord(letter) < 0x10FFFF else hi
            children.append((begin, end))
            begin = end
        stack += children
        heavy = max(children, key=lambda c: c[1] - c[0])
        letter = words[heavy[0]][at]
        merged: dict[str, list[int]] = {}
        for a, b in children:
            if (a, b) == heavy:
                continue
            for i in range(a, b):
                size = len(words[i]) - at
                if size > rest_most + 1:
                    continue
                rest = words[i][at + 1 :]
                merged.setdefault(rest, []).append(i)
                if rest[:1] != words[i][at]:  # else the pair branches deeper
                    j = index.get(prefix + rest)
                    if j is not None and owned(words[i], words[j], backward):
                        tally.pair(i, j)
                if size <= rest_most:
                    j = index.get(prefix + letter + words[i][at:])
                    if j is not None and owned(words[i], words[j], backward):
                        tally.pair(i, j)
        if terminal is not None:
            j = index.get(prefix + letter)
            if j is not None and owned(words[terminal], words[j], backward):
                tally.pair(terminal, j)
        for rest, own in merged.items():
            j = index.get(prefix + letter + rest)
            own = own if j is None else [*own, j]
            if len(own) > 1 and owned(words[own[0]], words[own[1]], backward):
                tally.group(own)


def _spelt(words: Sequence[str], backward: bool) -> list[str]:
    return [w[::-1] for w in words] if backward else list(words)


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted rows (key, body, n) one trie at a time."""
    key, bodies, ns = None, [], []

    def ended() -> pa.RecordBatch:
        backward = key[0] == "r"
        tally = Tally(_spelt(bodies, backward), ns)
        meet(bodies, len(key) - 1, backward, tally)
        return tally.batch()

    for batch in batches:
        for k, body, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                if len(bodies) > 1:
                    yield ended()
                key, bodies, ns = k, [], []
            bodies.append(body)
            ns.append(n)
    if len(bodies) > 1:
        yield ended()


def _level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (member, at, backward, bodies, ns): the words that are ``member`` without their letter at a place, and the member itself, which is longer than none of them."""
    for batch in batches:
        for member, at, backward, bodies, ns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tally = Tally(_spelt(bodies, backward), ns)
            longer = [i for i, b in enumerate(bodies) if b != member]
            short = [i for i, b in enumerate(bodies) if b == member]
            if len(longer) > 1 and owned(bodies[longer[0]], bodies[longer[1]], backward):
                tally.group(longer)
            for i in longer:
                for j in short:
                    if member[at : at + 1] != bodies[i][at] and owned(bodies[i], bodies[j], backward):
                        tally.pair(i, j)
            yield tally.batch()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form) of every word of words (word, n; distinct, longer than 2 * SHARED letters) that has near words: those that one inserted, deleted or replaced code point makes it.

    form: the near word of largest n, of several the first in code-point order. No pair becomes a row: each trie, and each group of words that differ in one letter, sends sums and the best only.
    """
    side = lambda mark, body: words.select(F.concat(F.lit(mark), F.substring(body, 1, SHARED)).alias("key"), body.alias("body"), "n")
    rows, found = side("f", F.col("word")).unionByName(side("r", F.reverse("word"))), []
    while True:
        hot = checkpointed(rows.groupBy("key").agg(F.count("*").alias("n_key")).where(F.col("n_key") > SHARD_WORDS))
        if hot.isEmpty():
            break
        few = hot.count() <= BROADCAST_KEYS
        hot = F.broadcast(hot.select("key")) if few else hot.select("key")
        split = checkpointed(rows.join(hot, "key"))
        rows = rows.join(hot, "key", "left_anti")
        at = F.length("key") - 1
        longer = split.where(F.length("body") > at).select(F.concat(F.expr("substring(body, 1, length(key) - 1)"), F.expr("substring(body, length(key) + 1)")).alias("member"), "key", "body", "n")
        groups = longer.unionByName(split.select(F.col("body").alias("member"), "key", "body", "n")).groupBy("key", "member").agg(F.collect_list(F.struct("body", "n")).alias("own"))
        groups = groups.where(F.size("own") > 1).select("member", at.alias("at"), F.col("key").startswith("r").alias("backward"), F.col("own.body").alias("bodies"), F.col("own.n").alias("ns"))
        found.append(checkpointed(groups.mapInArrow(_level, FOUND)))
        rows = checkpointed(rows.unionByName(split.where(F.length("body") > at).select(F.expr("concat(left(key, 1), substring(body, 1, length(key)))").alias("key"), "body", "n")))
    out = rows.repartition("key").sortWithinPartitions("key", "body").mapInArrow(_tries, FOUND)
    for part in found:
        out = out.unionByName(part)
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form")))
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("form_n"), F.col("b.form").alias("form"))


def group_variants(words: DataFrame, *, ratio: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of words (word, n).

    form: the near word of largest n, if that is ``ratio`` (2 or more) times the word's n or more, else null; root: where following the forms ends, the word itself if it has none. n grows by
    ``ratio`` with every step, so chains are short. Words must be distinct and longer than 2 * SHARED code points; an empty table stays empty.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = checkpointed(words.select("word", "n"))
    near = words.join(near_words(words), "word", "left")
    has = F.col("form_n") >= F.col("n") * ratio
    rows = checkpointed(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n")))
    links = rows.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps taken
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if links.join(ahead, "root", "left_semi").isEmpty():
            break
        links = checkpointed(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return rows.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))
