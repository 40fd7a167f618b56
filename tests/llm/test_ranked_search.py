"""Ranked search against scoring every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyrand.llm import ranked_search as R


def terms(text):
    return re.findall(R.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    """[(item, rank, doc_id, score)] from all documents; docs: (id, text)."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_words = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item in sorted({i for i, _ in items if i is not None}):
        own = {t for i, x in items if i == item for t in terms(x)}
        scored = []
        for d, c in counts:
            m = 50 + 50 * c.total() * n_docs // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0 and d is not None:
                scored.append((-score, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 40), st.integers(1, 50)), min_size=1, max_size=150, unique_by=lambda x: x[:2]), st.integers(1, 8), st.integers(0, 300), st.sampled_from([1, 3, 4096]))
def test_tree_against_all_sums(postings, k, floor, beam):
    t, d, x = (np.array(c, np.int64) for c in zip(*postings, strict=True))
    tree = R.WaveletTree.of(t, d, x, 8, 41)
    own, weights = np.array([0, 2, 3, 7]), np.array([3, 1, 5, 2])
    sums = Counter()
    for a, b, c in postings:
        if a in own:
            sums[b] += int(c * weights[own.tolist().index(a)])
    R.BEAM, held = beam, R.BEAM
    try:
        docs, scores = tree.best(own, weights, k, floor)
    finally:
        R.BEAM = held
    got = dict(zip(docs.tolist(), scores.tolist(), strict=True))
    assert len(got) == len(docs) and all(sums[b] == s for b, s in got.items())
    high = sorted((s for s in sums.values() if s >= floor), reverse=True)
    least = max(floor, high[k - 1]) if len(high) >= k else floor
    assert {b for b, s in sums.items() if s >= least} == set(got)


DOCS = [(1, "Red fish, blue FISH"), (2, "red red red"), (2, "red red red"), (3, None), (4, ""), (5, "...!"), (6, "blue"), (None, "fish blue"), (7, "Émile émile 東京"), (8, "fish " * 30_000 + "red"), (9, "the the blue fish"), (10, "blue"), (11, "under_score 9lives")]
ITEMS = [("a", "red FISH fish"), ("b", "blue"), ("b", "blue 東京"), ("c", None), ("d", "..."), (None, "red"), ("e", "Émile"), ("f", "absent"), ("g", "score 9lives")]


@pytest.mark.parametrize(("k", "pairs", "postings"), [(50, 10**6, 1 << 20), (2, 3, 2), (1, 1, 1)])
def test_odd_rows_blocks_and_shards(spark, monkeypatch, k, pairs, postings):
    monkeypatch.setattr(R, "BLOCK_PAIRS", pairs)
    monkeypatch.setattr(R, "SHARD_POSTINGS", postings)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in DOCS], "doc_id long, text string, score int, query string").repartition(5)
    items = spark.createDataFrame([(*x, 7) for x in ITEMS], "item_id string, text string, doc_id int")
    got = [tuple(r) for r in R.top_k(docs, items, k=k).orderBy("item_id", "rank").collect()]
    assert got == plain(DOCS, ITEMS, k) and got


def test_many_tasks(spark):
    """The first tasks' scores bound the others; ties go to the smaller id."""
    texts = [(i, f"w{i % 7} w{i % 11} w{i % 13} common" + " pad" * (i % 5)) for i in range(900)]
    items = [(i, f"w{i} w{i + 1} common pad") for i in range(6)]
    docs, asked = spark.createDataFrame(texts, "doc_id long, text string").repartition(12), spark.createDataFrame(items, "item_id long, text string")
    assert [tuple(r) for r in R.top_k(docs, asked, k=20).orderBy("item_id", "rank").collect()] == plain(texts, items, 20)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id string, text string")
    assert R.top_k(docs, items).collect() == []
    assert R.top_k(spark.createDataFrame(DOCS, docs.schema), items.limit(0)).collect() == []
