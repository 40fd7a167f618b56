"""Spelling variants against all pairs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyrand.llm import spelling_variants as S


def edits(word, known):
    """The known words that one edit makes of a word."""
    letters = sorted({c for w in known for c in w})
    found = {word[:i] + word[i + 1 :] for i in range(len(word))}
    found |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    found |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return (found & set(known)) - {word}


def plain(counts, ratio=10):
    """{word: (n_near, form, form_n, root)} by trying all edits of all words."""
    out = {}
    for w in counts:
        near = edits(w, counts)
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form = best if best and counts[best] >= ratio * counts[w] else None
        out[w] = (len(near), form, counts.get(form))
    root = lambda w: root(out[w][1]) if out[w][1] else w
    return {w: (*x, root(w)) for w, x in out.items()}


def got(spark, counts, **options):
    rows = S.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3), **options).collect()
    assert len(rows) == len(counts)
    return {r.word: (r.n_near, r.form, r.form_n, r.root) for r in rows}


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("aabcé", min_size=7, max_size=9), min_size=2, max_size=60), st.randoms())
def test_tries_against_all_edits(words, random):
    """Forward and reversed tries together count every pair once."""
    words = sorted(words | {w[:2] + "b" + w[3:] for w in list(words)[:8]} | {"a" * 7, "a" * 8, "b" + "a" * 7, "aaab" + "a" * 4})
    ns = [random.randint(1, 5) for _ in words]
    total, best = dict.fromkeys(words, 0), {}
    for backward in (False, True):
        spelt = sorted((S._spelt([w], backward)[0], n) for w, n in zip(words, ns, strict=True))
        for key in {b[: S.SHARED] for b, _ in spelt}:
            own = [(b, n) for b, n in spelt if b.startswith(key)]
            bodies = [b for b, _ in own]
            tally = S.Tally(S._spelt(bodies, backward), [n for _, n in own])
            S.meet(bodies, len(key), backward, tally)
            for i, w in enumerate(tally.words):
                total[w] += tally.near[i]
                if tally.best[i] is not None:
                    best[w] = min(best.get(w, (0, "")), tally.order(tally.best[i]))
    counts = dict(zip(words, ns, strict=True))
    for w in words:
        near = edits(w, words)
        assert total[w] == len(near), w
        assert best.get(w) == min(((-counts[x], x) for x in near), default=None)


COUNTS = {"letters": 100_000, "lettrs": 3, "leters": 9, "lettters": 10_000, "letterss": 900, "lettersss": 5, "better ": 2, "fetters": 100_000, "strasse": 40, "straße": 4, "straßen": 400, "aaaaaaa": 7, "aaaaaaaa": 70, "aaaaaaaaa": 700, "abaaaaaa": 7000, "xetterss": 12}
COUNTS = {w: n for w, n in COUNTS.items() if len(w) >= 7} | {"zz" + "y" * 4000: 5, "zz" + "y" * 4001: 50, "q" + "z" + "y" * 3999 + "q": 1}


def test_chains_and_ties(spark):
    found = got(spark, COUNTS)
    assert found == plain(COUNTS)
    assert found["lettersss"][3] in ("letters", "fetters")
    assert found["zz" + "y" * 4000][1] == "zz" + "y" * 4001


@pytest.mark.parametrize("most", [1, 3])
def test_split_shards(spark, monkeypatch, most):
    """Shards that are split letter by letter give the same rows."""
    monkeypatch.setattr(S, "SHARD_WORDS", most)
    short = {w: n for w, n in COUNTS.items() if len(w) < 100} | {f"prefix{a}{b}": 3 + k for k, (a, b) in enumerate((a, b) for a in "abc" for b in "abcdé")} | {f"{a}xsuffix": 90 for a in "abcd"}
    assert got(spark, short, ratio=2) == plain(short, 2)


def test_vocabulary_of_odd_rows(spark):
    rows = [(1, "Straßen, STRAßEN straßen", "a"), (1, "Straßen, STRAßEN straßen", "a"), (None, "nothing nothing", "b"), (2, None, "c"), (3, "", "d"), (4, "longword " * 20_000, "e"), (5, "once-only ÄÄÄÄÄÄÄ ÄÄÄÄÄÄÄ short short", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    assert {r.word: r.n for r in S.vocabulary(docs).collect()} == {"straßen": 6, "nothing": 2, "longword": 20_000, "ÄÄÄÄÄÄÄ": 2}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.group_variants(S.vocabulary(none)).collect() == []
