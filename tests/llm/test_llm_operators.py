"""Small cases of each operator: nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrand.llm import _spark, _words, byte_bpe, chat_format, decontaminate, jaccard_join, language_id, line_dedup, secret_scan, topk_search, toxicity, url_filter
from tallyrand.llm._components import components
from tallyrand.operators import joint

TEXTS = [(1, "one two three four five six seven"), (2, None), (3, ""), (4, "  \n\t "), (1, "one two three four five six seven"), (None, "one two three four five six seven"), (5, "word"), (6, "WORD")]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def thue_morse(n, flip=0):
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


@pytest.mark.parametrize(("a", "b"), [("x" + "q" * 8191, "q" * 4096 + "x" + "q" * 4095), *((thue_morse(1 << k), thue_morse(1 << k, 1)) for k in (10, 11, 12, 13, 14))])
def test_word_hashes_of_long_words(spark, a, b):
    """Words whose bytes' sums agree by construction where places have powers of one factor."""
    data = np.frombuffer(f"{a} {b} {a}".encode(), np.uint8)
    starts, _ = _words.word_bounds(data, np.array([0, len(data)]), _words.BLANKS)
    x, y, z = _words.word_hashes(data, starts, _words.BLANKS)
    assert x != y and x == z


def test_near_duplicates_of_long_words(spark):
    texts = [t for k in (11, 12) for t in (thue_morse(1 << k), thue_morse(1 << k, 1))]
    out = jaccard_join.near_duplicates(frame(spark, list(enumerate(texts)))).collect()
    assert [r.component_id for r in sorted(out)] == [0, 1, 2, 3]


# -- language ID


def test_language_edges(spark):
    rng = random.Random(1)
    made = [(i, " ".join(rng.choice(("the and of in".split(), "der und die ein".split())[i % 2]) for _ in range(30)), ("en", "de")[i % 2], "x") for i in range(60)]
    docs = spark.createDataFrame([*made, (100, None, "en", "x"), (101, "12 34", "en", "x"), (None, "the of and", None, "x")], "doc_id long, text string, lang string, score string")
    model = language_id.fit(docs)
    out = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert out[100].lang_pred == out[101].lang_pred == "und" and out[100].score == 0
    assert out[None].lang_pred == "en"
    assert np.mean([out[i].lang_pred == lang for i, _, lang, _ in made]) > 0.95
    none = language_id.predict(docs, language_id.fit(docs.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_presence_of_a_long_text_is_that_of_its_slices(monkeypatch):
    rng = random.Random(9)
    for text in ("abc def " * 1000, "".join(rng.choice("abcdeÄß,. 1") for _ in range(500)), "123 !"):
        a, b = np.zeros(language_id.BUCKETS, np.float32), np.zeros(language_id.BUCKETS, np.float32)
        whole = language_id.mark(text, a)
        with monkeypatch.context() as m:
            m.setattr(language_id, "SLICE", 7)
            assert language_id.mark(text, b) == whole == (text != "123 !")
        assert (a == b).all()


def test_kernel_against_sets_of_ngrams():
    """The kernel, the landmarks' space and the ridge regressions, from plain sets and numpy."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(("the and of in to is".split(), "der und die ein zu ist".split(), "le et la un que est".split())[i % 3]) for _ in range(9)) for i in range(45)]
    langs = [("en", "de", "fr")[i % 3] for i in range(45)]

    def grams(text):
        chars = " " + " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split()) + " "
        return {chars[i : i + n] for n in range(1, 5) for i in range(len(chars) - n + 1)}

    sets = [grams(t) for t in texts]
    packed = []
    for t in texts:
        row = np.zeros(language_id.BUCKETS, np.uint8)
        language_id.mark(t, row)
        packed.append(np.packbits(row))
    model = language_id.solve(packed, langs, 9, 0.1)
    own = model.kernel(np.unpackbits(np.array(packed), axis=1).astype(np.float32))
    marks = [i for name in ("de", "en", "fr") for i in [j for j, x in enumerate(langs) if x == name][:3]]
    plain = np.array([[len(a & sets[m]) / np.sqrt(len(a) * len(sets[m])) for m in marks] for a in sets])
    assert np.abs(own - plain).max() < 0.02  # two n-grams may share a bucket
    values, vectors = np.linalg.eigh(own[marks].astype(float))
    keep = values > 1e-6 * values[-1]
    space = np.hstack([own @ vectors[:, keep] / np.sqrt(values[keep]), np.ones((45, 1))])
    y = np.where(np.array(langs)[:, None] == np.array(model.languages)[None], 1.0, -1.0)
    penalty = np.diag([0.1] * int(keep.sum()) + [0.0])
    want = space @ np.linalg.lstsq(np.vstack([space, np.sqrt(penalty)]), np.vstack([y, np.zeros((len(penalty), 3))]), rcond=None)[0]
    assert np.abs(model.scores(np.unpackbits(np.array(packed), axis=1).astype(np.float32)) - want).max() < 1e-3


# -- toxicity


def chained(spark, seed=3, n=240):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        bad, vile = rng.random() < 0.4, rng.random() < 0.5
        rows.append((i, " ".join(rng.sample("sun moon star tree rock lake".split(), 3) + ["grim"] * bad + ["idiot"] * (bad and vile)), int(not bad), int(bad and vile)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")


def test_chain_feeds_earlier_categories(spark):
    rows, df = chained(spark)
    docs, labels = df.select("doc_id", "text"), df.where("doc_id % 2 = 0").select("doc_id", "quality", "toxic")
    out = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert np.mean([out[i].toxic == bool(t) for i, _, _, t in rows if i % 2]) > 0.99  # not learnt from
    chain = toxicity.fit(docs, labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic"), ["low_quality", "toxic"])
    assert [len(w) for w in chain.earlier] == [0, 1] and 0 < chain.thresholds[1] < 1
    # The whole chain from its numbers, text by text.
    for i, text, *_ in rows:
        terms = {x for w in re.findall(r"[^\W\d_]+", text.lower()) for x in (w, "^" + w[:4])}
        p = []
        for weights, earlier, constant in zip(chain.weights, chain.earlier, chain.constants, strict=True):
            z = constant + sum(w for t, w in zip(chain.terms, weights, strict=True) if t in terms) + sum(w * q for w, q in zip(earlier, p, strict=True))
            p.append(1 / (1 + np.exp(-z)))
        assert np.allclose(p, [out[i].p_low_quality, out[i].p_toxic], atol=1e-9)


def test_fold_models_are_those_of_the_other_folds(spark):
    """The last category's model is the one that a solver finds given out-of-fold probabilities of the first: no better solution of the penalised loss is near."""
    rows, df = chained(spark)
    labels = df.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    one = toxicity.fit(df.select("doc_id", "text"), labels, ["low_quality"], iterations=200)
    both = toxicity.fit(df.select("doc_id", "text"), labels, ["low_quality", "toxic"], iterations=200)
    assert one.terms == tuple(t for t, w in zip(both.terms, both.weights[0], strict=True) if w) or set(one.terms) <= set(both.terms)
    assert dict(zip(one.terms, one.weights[0], strict=True))["grim"] > 1
    assert both.constants[0] == pytest.approx(one.constants[0])


def test_chain_against_a_numpy_refit(spark):
    """The whole fit once more over one matrix: standardised terms, models without each fold, their probabilities as the later category's feature."""
    rows, df = chained(spark)
    labels = df.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.fit(df.select("doc_id", "text"), labels, ["low_quality", "toxic"])
    fold = {r.doc_id: r.f for r in df.select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), "doc_id", F.xxhash64("text")), F.lit(3)).alias("f")).collect()}
    texts = {r.doc_id: toxicity.terms_of(r.text) for r in df.collect()}
    ids, n = sorted(texts), len(texts)
    counts = collections.Counter(t for x in texts.values() for t in x)
    terms = [t for t, k in sorted(counts.items(), key=lambda c: (-c[1], c[0])) if k >= 3]
    x = np.array([[t in texts[i] for t in terms] for i in ids], float)
    spread = x.std(0, ddof=1)
    x = x * np.divide(1, spread, out=np.zeros(len(terms)), where=spread > 0)
    scale = np.divide(1, spread, out=np.zeros(len(terms)), where=spread > 0)
    marks = {r.doc_id: r for r in labels.collect()}
    folds, found = np.array([fold[i] for i in ids]), []
    for k, name in enumerate(["low_quality", "toxic"]):
        y = np.array([marks[i][name] for i in ids], float)
        wide, used = np.hstack([x, np.ones((n, 1))]), [np.ones(n, bool), *(folds != f for f in range(3))]

        def evaluate(weights, which, wide=wide, used=used, y=y):
            out = []
            for w, p in zip(weights, which, strict=True):
                z, u = wide @ w, used[p]
                out.append([(np.logaddexp(0, z) - y * z)[u].sum(), u.sum(), *(((1 / (1 + np.exp(-z)) - y) * u) @ wide)])
            return np.array(out)

        w = joint.minimised(evaluate, [joint.Problem(p) for p in range(4)], wide.shape[1], l1=3.6 / n, steps=40, tolerance=toxicity.TOLERANCE)
        found.append(w[0][:-1] * scale)
        own = dict(zip(chain.terms, chain.weights[k], strict=True))
        assert max(abs(own.get(t, 0) - v) for t, v in zip(terms, found[k], strict=False)) < 1e-6
        assert np.allclose(chain.earlier[k], found[k][len(terms) :], atol=1e-6) and abs(chain.constants[k] - w[0][-1]) < 1e-6
        p = 1 / (1 + np.exp(-(wide @ w.T)))
        held = p[np.arange(n), folds + 1]
        assert chain.thresholds[k] == pytest.approx(toxicity.best_threshold(held, y), abs=1e-6)
        x, scale = np.hstack([x, (held / held.std(ddof=1))[:, None]]), np.append(scale, 1 / held.std(ddof=1))


def test_samples_are_bounded_by_rows(spark):
    """2,000 rows of one id, some of them alike, send no more rows to the driver than the sample has."""
    docs = spark.range(2000).selectExpr("7L as doc_id", "concat('word text number ', id % 1500) as text", "'en' as lang")
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.sampled(docs, labels, ["quality", "toxic"], "doc_id", "text", 40).count() == 40
    whole = toxicity.sampled(docs, labels, ["quality", "toxic"], "doc_id", "text", 5000).collect()
    assert len(whole) == len({r.text for r in whole}) == 1500
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(language_id, "solve", lambda present, langs, *_: seen.append(len(langs)))
        language_id.fit(docs, sample_rows=300)
        language_id.fit(docs.unionByName(docs.withColumn("lang", F.lit("de"))), sample_rows=300)
        language_id.fit(docs, sample_rows=5000)
    assert seen == [300, 300, 1500]


def test_threshold_parts_best():
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.2).astype(float)
    p = np.clip(0.02 + 0.05 * y + rng.normal(size=400) * 0.012, 0.001, 0.999)
    t = toxicity.best_threshold(p, y)
    value = lambda t: (p[y == 1] >= t).sum() + (p[y == 0] < t).sum()
    assert value(t) >= max(value(x) for x in p)
    assert toxicity.best_threshold(np.array([0.1, 0.9]), np.zeros(2)) == toxicity.best_threshold(np.array([]), np.array([])) == 0.5


def test_toxicity_keeps_columns_of_any_name(spark):
    _, df = chained(spark)
    names = ("row", "hits", "p0", "p1", "_terms", "terms", "features", "words", "fold", "raw", "predicted", "y0", "id")
    docs = df.select("doc_id", "text").withColumns({c: F.lit(c) for c in names}).withColumn("P_toxic", F.lit("old"))
    out = toxicity.score(docs, df.select("doc_id", "quality", "toxic"))
    assert out.columns == ["doc_id", "text", *names, "p_low_quality", "p_toxic", "toxic"]
    assert all(out.first()[c] == c for c in names) and out.count() == 240


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(2, 0, 1), (2, 0, 1), (None, 1, 1), (1, None, 1)], [(1, 1, 0), (5, 0, 1)]])
def test_toxicity_edges(spark, labels):
    out = toxicity.score(frame(spark, TEXTS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(TEXTS)
    assert not any(r.toxic for r in out if not (r.text or "").strip())


# -- decontamination


def plain_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_against_the_plain_recurrence():
    rng = random.Random(5)
    for _ in range(60):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 14))] for _ in range(2))
        score, start, end = decontaminate.align(np.array(a, np.uint64), np.array(b, np.uint64))
        assert score == plain_alignment(a, b)
        assert plain_alignment(a[start:end], b) == score


def test_edited_copies_are_found(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    item = [word() for _ in range(40)]
    around = lambda n: [word() for _ in range(n)]
    edited = list(item)
    for i in (5, 14, 23, 32):
        edited[i] = word()
    del edited[18]
    edited[27:27] = around(2)
    docs = [(1, around(300) + item + around(200)), (2, around(50) + edited), (3, around(400)), (4, around(20) + item[:8] + around(20)), (5, [w.upper() + "," for w in item])]
    rows = frame(spark, [(i, " ".join(w)) for i, w in docs] + [(6, None), (7, ""), (None, " ".join(item))])
    items = frame(spark, [(9, " ".join(item)), (10, None), (11, "ab"), (None, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(rows, items).collect()}
    assert set(got) == {(1, 9), (2, 9), (5, 9), (None, 9)}
    assert got[1, 9].score == 1 and (got[1, 9].start_word, got[1, 9].end_word) == (300, 340)
    assert decontaminate.contaminated(rows.limit(0), items).count() == decontaminate.contaminated(rows, items.limit(0)).count() == 0


@pytest.mark.parametrize("size", [3, 5000])
def test_filter_has_the_bits_of_its_grams(spark, size):
    """The filter that Spark's bitmaps merge is the one set bit by bit."""
    grams = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, size)
    held = decontaminate._filter(spark.createDataFrame([(int(g),) for g in grams] * 2, "gram long").repartition(3)).value
    want = np.zeros(len(held) * 8, bool)
    want[decontaminate._bits(grams.view(np.uint64), len(held) * 8).ravel()] = True
    assert (np.unpackbits(held, bitorder="little").astype(bool) == want).all()
    assert decontaminate._passes(held, grams.view(np.uint64)).all()


def test_many_repeats_of_a_row(spark):
    """Each repeat is told; they add nothing to what is aligned."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    item = [word() for _ in range(30)]
    text = " ".join([word() for _ in range(20)] + item + [word() for _ in range(20)] + item[:28])
    rows = frame(spark, [(1, text)] * 700 + [(2, " ".join(word() for _ in range(50)))] * 50)
    got = decontaminate.contaminated(rows, frame(spark, [(4, " ".join(item))], "item_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 4, 1.0, 20, 50)] * 700


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.2, 0.3, 0.4])
def test_recall_at_edit_rates(spark, rate):
    """Items of which words are replaced, left out or put in: of the copies whose whole alignment reaches the bound, nine in ten are found, and no others."""
    rng = random.Random(int(rate * 100))
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(7))
    items = {i: [word() for _ in range(rng.randint(15, 59))] for i in range(40)}
    copies = {}
    for i, words in items.items():
        out = []
        for w in words:
            kind = rng.random()
            out += [w] if kind >= rate else [word()] if kind < rate / 3 else [] if kind < 2 * rate / 3 else [w, word()]
        copies[i] = [word() for _ in range(10)] + out + [word() for _ in range(10)]
    found = decontaminate.contaminated(frame(spark, [(i, " ".join(w)) for i, w in copies.items()]), frame(spark, [(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")).collect()
    number = {w: n for n, w in enumerate(sorted({w for ws in (*items.values(), *copies.values()) for w in ws}), 1)}
    as_numbers = lambda ws: np.array([number[w] for w in ws], np.uint64)
    due = {i for i in items if decontaminate.align(as_numbers(copies[i]), as_numbers(items[i]))[0] >= 0.45 * 2 * len(items[i])}
    got = {r.doc_id for r in found}
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i in got}
    assert got <= due and len(got) >= 0.9 * len(due) and len(due) >= 20, (rate, len(got), len(due))


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_many_items_and_copies(spark, monkeypatch, broadcast):
    """Seeds broadcast or shuffled, items that share words, repeated items and rows."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    docs = frame(spark, [(i, f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i} zeta{i} the same end for all") for i in range(12)] + [(3, "alpha3 beta3 gamma3 delta3 epsilon3 zeta3 the same end for all")]).withColumn("item", F.lit("clash"))
    items = docs.withColumnRenamed("doc_id", "item_id").withColumn("key", F.lit(1))
    pairs = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect() if r.score == 1)
    assert pairs == sorted([(i, i) for i in range(12)] + [(3, 3)] * 3)


def test_long_texts_and_items(spark):
    """A text that repeats an item 20,000 times, and an item of 100,000 words: what an alignment holds grows with their sum."""
    item = " ".join(f"w{k}" for k in range(50))
    long_item = " ".join(f"long{k}" for k in range(100_000))
    docs = frame(spark, [(1, (item + " ") * 20_000), (2, " ".join(f"long{k}" for k in range(70_000, 72_000))), (3, item)])
    items = frame(spark, [(7, item), (8, long_item)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.score) for r in decontaminate.contaminated(docs, items).collect()) == [(1, 7, 1.0), (3, 7, 1.0)]


# -- line dedup


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_lines(spark, monkeypatch, broadcast):
    monkeypatch.setattr(_spark, "BROADCAST_KEYS", broadcast)
    monkeypatch.setattr(_spark, "COMMON_SHARE", 0.5)
    rows = [(i, f"All rights reserved.\nown line {i}\n\nAll rights reserved.", f"s{i}") for i in range(12)] + [(20, None, "s1"), (21, "", None), (None, "All rights reserved.", "s3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_lines", F.lit("x")).withColumn("line", F.lit(1)).withColumn("gone", F.lit(2)).withColumn("pieces", F.lit(3))
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert out[0].text == rows[0][1] and out[0].n_removed == 0 and out[0].n_lines == 4
    assert all(out[i].text == f"own line {i}\n" and out[i].n_removed == 2 for i in range(1, 12))
    assert out[20].text is None and out[20].n_lines == 0 and out[21].text == "" and out[None].n_removed == 0
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_a_text_of_very_many_lines(spark):
    """All but every fourth of 100,000 lines go; the time grows with the lines."""
    many = [f"common line {k}" if k % 4 else f"only here {k}" for k in range(100_000)]
    rows = [(i, "\n".join(many[k] for k in range(1, 100_000) if k % 4), f"s{i}") for i in range(3)] + [(9, "\n".join(many), "s9")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df, min_sites=4).collect()}
    assert out[9].text == "\n".join(many[::4]) and out[9].n_removed == 75_000 and out[0].n_removed == 0 and out[1].text == ""


def test_threshold_counts_are_exact(spark):
    """Around the threshold of 100 sites, where the sketch may err, the decision is that of the exact count."""
    rows = [(i, "\n".join(f"this is line {k}" for k in range(97, 104) if i < k), f"s{i}") for i in range(103)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    lines = line_dedup.boilerplate(df, min_sites=100, lg_k=4)
    wanted = spark.createDataFrame([(f"this is line {k}",) for k in range(100, 104)], "t string").select(F.xxhash64("t")).collect()
    assert sorted(r.line for r in lines.collect()) == sorted(r[0] for r in wanted)


# -- n-gram Jaccard join


def plain_components(rows):
    sets = []
    for i, t in rows:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    parent = list(range(len(sets)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(sets), 2):
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            parent[top(b)] = top(a)
    least = {}
    for k, (i, s) in enumerate(sets):
        if s and i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, len(s), least.get(top(k)) if s else i) for k, (i, s) in enumerate(sets)), key=str)


def joined(spark, rows):
    return sorted((tuple(r) for r in jaccard_join.near_duplicates(frame(spark, rows)).collect()), key=str)


def test_join_edges(spark):
    assert joined(spark, TEXTS) == plain_components(TEXTS)
    assert joined(spark, []) == []


@pytest.mark.parametrize("seed", range(3))
def test_join_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    shared = [word() for _ in range(25)]
    rows = []
    for g in range(14):
        base = [word() for _ in range(rng.choice((3, 8, 30, 90)))]
        for _ in range(rng.choice((1, 2, 12))):
            t = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                t[rng.randrange(len(t))] = word()
            rows.append((len(rows), " ".join(t + shared * (g % 3 == 0))))
    assert joined(spark, rows) == plain_components(rows)


def test_large_groups_of_near_copies(spark, monkeypatch):
    """One group, with copies at all distances, of which some are near to none: pivots and deltas find what all pairs find."""
    rng = random.Random(11)
    base = [f"b{k}" for k in range(100)]
    rows = []
    for i in range(160):
        t = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 3, 4))):
            t[rng.randrange(100)] = f"x{rng.randrange(60)}"
        rows.append((i, " ".join(t)))
    assert joined(spark, rows) == plain_components(rows)


def matrix_components(rows):
    """As plain_components(), for many rows of ids and at least five words: all pairs at once, by the matrix of the tokens that several sets have."""
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)), strict=False)) for _, t in rows]
    number = {g: k for k, (g, n) in enumerate(collections.Counter(g for s in sets for g in s).items()) if n > 1}
    number = {g: k for k, g in enumerate(number)}
    has = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        has[i, [number[g] for g in s if g in number]] = 1
    both, n = has @ has.T, np.array([len(s) for s in sets])
    near = 100 * both >= 80 * (n[:, None] + n[None] - both)
    np.fill_diagonal(near, True)
    least = np.arange(len(rows))
    while True:
        now = np.array([least[near[i]].min() for i in range(len(rows))])
        if (now == least).all():
            return sorted(((i, int(k), rows[m][0]) for (i, _), k, m in zip(rows, n, least, strict=True)), key=str)
        least = now


@pytest.mark.parametrize("edits", [(1, 2, 3, 4, 5, 6), (6,), (3, 4)])
def test_thousands_of_edited_copies(spark, edits):
    """Groups in which many, few and no copies are linked, some of them in two variants of one text, against all pairs."""
    rng = random.Random(len(edits))
    base = [f"b{k}" for k in range(200)]
    variant = base[:60] + [f"c{k}" for k in range(60)] + base[120:]
    rows = []
    for i in range(2000):
        t = list(variant if i % 3 == 0 else base)
        for _ in range(rng.choice(edits)):
            t[rng.randrange(200)] = f"x{rng.randrange(100)}" if i % 2 else f"y{i}"
        rows.append((i, " ".join(t[rng.randrange(9) :] if i % 5 == 0 else t)))
    want = matrix_components(rows)
    assert 10 < len({r[2] for r in want}) <= 2000
    assert joined(spark, rows) == want


def test_large_groups_of_repeated_rows(spark):
    """All rows of a large group repeated, some of them with different texts of one id: the copies change no prefix, and no link is lost."""
    rng = random.Random(11)
    rows = []
    for i in range(121):
        t = [f"b{k}" for k in range(100)]
        for _ in range(rng.choice((1, 2, 3, 3, 4))):
            t[rng.randrange(100)] = f"x{rng.randrange(60)}"
        rows.append((i - i % 2 if i < 20 else i, " ".join(t)))
    rows = rows * 3
    assert joined(spark, rows) == plain_components(rows)


def test_rows_without_an_id_are_bridges(spark):
    """Texts that are similar only to one that no row with an id has, in a small bucket and in a large one."""
    rows = []
    for g, n in enumerate((2, 48)):
        for i in range(n):
            t = [f"g{g}w{k}" for k in range(100)]
            t[5 + i] = t[30 + i] = f"g{g}x{i}"
            rows.append((len(rows), " ".join(t)))
        rows += [(None, " ".join(f"g{g}w{k}" for k in range(100)))] * 2
    assert joined(spark, rows) == plain_components(rows)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1040)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {n: n for e in edges for n in e}
    for _ in range(len(parent)):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert all(got.get(n, n) == p for n, p in parent.items())


def test_components_of_few_edges_are_one_job(spark, monkeypatch):
    """A chain, loops, repeated and null edges: the same in one task as by rounds, and without the rounds' jobs."""
    from tallyrand.llm import _components

    edges = [(k + 1, k) for k in range(2000, 0, -2)] + [(k, k + 1) for k in range(2, 1990, 2)] + [(5000, 5000), (7000, -9), (-9, 7000), (None, 3), (9_000_000_000, -9)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(7).cache()
    df.count()
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    before = jobs()
    few = sorted(map(tuple, _components.components(df).collect()))
    assert jobs() - before <= 4
    monkeypatch.setattr(_components, "SMALL", 0)
    assert few == sorted(map(tuple, _components.components(df).collect()))
    assert (9_000_000_000, -9) in few and 5000 not in dict(few)
    assert _components.components(df.limit(0)).collect() == []


def test_word_hashes_over_blocks(monkeypatch):
    text = ("Alpha beta  gamma\n" * 50).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    starts, before = _words.word_bounds(data, offsets, _words.BLANKS)
    whole = _words.word_hashes(data, starts, _words.BLANKS)
    monkeypatch.setattr(_words, "BLOCK", 40)
    assert (whole == _words.word_hashes(data, starts, _words.BLANKS)).all()
    assert len(set(whole.tolist())) == 3 and before.tolist() == [0, 150]


# -- chat formatting


def test_fold():
    log = [(1, 0, 1, "message", "user", "hi"), (1, 1, 2, "message", "assistant", "he"), (1, 1, 3, "delta", None, "llo"), (1, 1, 7, "edit", None, "hey"), (1, 2, 4, "message", "user", "old"), (1, 2, 5, "delta", None, "er"), (2, 0, 1, "delta", None, "lost"), (2, 1, 2, "message", None, None), (2, 2, 3, "message", "user", "x"), (2, 2, 4, "retract", None, None)]
    assert list(chat_format.fold(log)) == [(1, "user", "hi"), (1, "assistant", "hey"), (1, "user", "older"), (2, "", "")]
    again = [(1, 0, 1, "message", "user", "q"), (1, 1, 2, "message", "assistant", "bad"), (1, 1, 5, "regenerate", None, None), (1, 1, 6, "delta", None, "good"), (1, 2, 3, "message", "user", "void"), (1, 2, 8, "message", "user", "new")]
    assert [m[1:] for m in chat_format.fold(again)] == [("user", "q"), ("assistant", "good"), ("user", "new")]


@pytest.mark.parametrize("text", ["", "<|im_end|>", r"<\|a<\\|b<|", "<|" * 5, "a\\<|\n", "<<||>>"])
def test_escaping_is_reversible(text):
    assert chat_format.unescape(chat_format.escape(text)) == text and "<|" not in chat_format.escape(text)
    assert chat_format.unescape_role(chat_format.escape_role(text)) == text and "\n" not in chat_format.escape_role(text)


def test_chat_edges(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, 0, None, "x"), (2, None, "assistant", "<|im_start|>")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash")).withColumn("kind", F.lit(1))
    segments = chat_format.format_events(chat_format.as_log(messages))
    out = {r.conv_id: r for r in chat_format.digest(segments).collect()}
    assert out[1].n_turns == 3 and out[1].loss_chars == 2 and out[2].loss_chars == 12 and out[None].n_turns == 1
    assert sorted(map(str, chat_format.digest(segments.orderBy(F.desc("pos"))).collect())) == sorted(map(str, chat_format.digest(segments, in_order=True).collect()))
    assert chat_format.digest(chat_format.format_events(chat_format.as_log(messages.limit(0)))).count() == 0


# -- byte-level BPE


def test_bpe_random_bytes_and_long_runs(spark):
    import public_tokenizers as P
    import regex
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks, reachable = byte_bpe.load(path)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder, pattern = byte_bpe.Encoder(ranks, reachable), regex.compile(P.PATTERN)
    rng = random.Random(1)
    texts = ["".join(rng.choice("aehtinö ABé0😀中\n\t'_") for _ in range(rng.randint(0, 200))) for _ in range(300)] + ["a" * 3000, "the" * 900, " " * 2000]
    for t in texts:
        assert np.frombuffer(byte_bpe.encode_text(t, pattern, encoder), "<u4").tolist() == own.encode_ordinary(t)
    df = frame(spark, [(1, "héllo wörld"), (2, None), (1, "héllo wörld"), (3, "")]).withColumn("ids", F.lit("clash"))
    out = byte_bpe.decode(byte_bpe.encode(df, path=path, pattern=P.PATTERN), path=path).collect()
    assert [bytes(r.decoded).decode() for r in out] == [t or "" for t in ("héllo wörld", None, "héllo wörld", "")]
    assert byte_bpe.encode(df.limit(0), path=path, pattern=P.PATTERN).count() == 0


def test_long_texts_are_encoded_bit_by_bit(monkeypatch):
    import public_tokenizers as P
    import regex

    encoder, pattern = byte_bpe.Encoder(*byte_bpe.load(P.path("byte_bpe_multi_50k.tiktoken"))), regex.compile(P.PATTERN)
    text = "some words, and more; " * 50
    whole = byte_bpe.encode_text(text, pattern, encoder)
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 10)
    monkeypatch.setattr(byte_bpe, "PIECES_AT_ONCE", 7)
    assert byte_bpe.encode_text(text, pattern, encoder) == whole


# -- URL filters


def test_url_edges(spark):
    urls = [(1, "http://A.Example.NET/en/x"), (2, "https://b.net"), (3, None), (4, "no scheme"), (5, "http://x.org/fr/?q#f"), (6, "http://sub.example.com/de/1"), (7, "http://good.com/?"), (7, "http://good.com/?"), (8, "http://bad.com#x"), (9, "ftp://new.bad.com/a\nb")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("clash"))
    outcomes = spark.createDataFrame([("good.com", True)] * 40 + [("bad.com", False)] * 40 + [("good.com", None)], "host string, good boolean")
    rules = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
    out = {r.page_id: r for r in url_filter.filter_urls(pages, outcomes, rules).collect()}
    assert (out[1].host, out[1].rule, out[1].verdict) == ("a.example.net", "example.net/en/", "allow")
    assert (out[2].path, out[2].rule) == ("", None) and (out[3].host, out[3].path) == ("", "") and out[9].path == "/a\nb"
    assert out[5].verdict == "allow" and out[6].rule == "example.com/de/" and out[7].verdict == "allow" and out[8].verdict == "block"
    assert out[9].good_mean < 0.2  # a new host takes its domain's rate
    assert out[8].good_mean > 0 and out[7].good_mean < 1  # shrunk towards the level above
    none = url_filter.filter_urls(pages, outcomes.limit(0), rules)
    assert none.where("rule is null and verdict <> 'allow'").count() == 0 and none.count() == len(urls)


# -- top-k search


def test_top_k_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(300, 6)) * 20).astype(int)
    x[50:120] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (None, [1] * 6), (901, [5, 5]), (902, [1, 2])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    queries = df.where("vec_id % 60 = 0 or vec_id = 901")
    got = {}
    for r in topk_search.top_k(df, queries, k=5, shard_rows=40, shards_per_task=2).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    usable = [(i, np.array(v)) for i, v in rows if i is not None and v is not None]
    for q, v in usable:
        if q % 60 == 0 or q == 901:
            best = sorted((-int(v @ w), i) for i, w in usable if i != q and len(w) == len(v))[:5]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk_search.top_k(df.limit(0), queries, k=5).count() == 0


@pytest.mark.parametrize("copies", [2, 20])
def test_top_k_with_repeated_rows_of_the_query(spark, copies):
    """All of the query's own rows score highest in their leaf; none of them takes a neighbour's place."""
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(100, 4)) * 20).astype(int)
    x[0] = 99
    rows = [(0, x[0].tolist())] * copies + [(i, v.tolist()) for i, v in enumerate(x) if i]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = sorted((r.rank, r.vec_id, r.score) for r in topk_search.top_k(df, df.where("vec_id = 0"), k=5).collect())
    best = sorted((-int(x[0] @ x[i]), i) for i in range(1, 100))[:5]
    assert got == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_scaling(spark):
    df = spark.createDataFrame([(1, [0.5, -0.0001]), (2, [float("nan")]), (3, [float("inf")]), (4, [None]), (5, None), (6, [])], "vec_id long, e array<float>")
    out = {r.vec_id: r.v for r in df.select("vec_id", topk_search.scaled(F.col("e"), 1024).alias("v")).collect()}
    assert out == {1: [512, -1], 2: None, 3: None, 4: None, 5: None, 6: []}


# -- secret scans


def test_secret_ownership(spark):
    own, wide = "Qw3rTy7UiOpAsDfGhJk9", "Zx8CvBnMqWeRtYuIoP12"
    rows = [(1, f"key {own} end", "a"), (2, None, "a"), (3, "", None)] + [(10 + i, f"é😀 {wide} token={wide[:10]}", f"s{i}") for i in range(4)] + [(1, f"key {own} end", "a"), (30, "token=abc password: 'hunter22'", "a"), (31, "token=token:abcdefgh", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("found", F.lit(1)).withColumn("row", F.lit(2))
    out = secret_scan.scan(df, owner=F.col("source"), repository=F.col("source")).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    assert by[1].spans == "owned:4:24" and by[10].spans == "assign:24:40" and by[10].n_shared == 1
    assert by[2].spans == by[3].spans == "" and by[30].spans == "assign:10:29" and by[31].spans == ""
    assert secret_scan.scan(df.limit(0), owner=F.col("source"), repository=F.col("source")).count() == 0


def test_a_text_of_very_many_secrets(spark):
    """100,000 matches of several kinds in one text: spans as the patterns place them, in time that grows with their number."""
    rng = random.Random(8)
    make = lambda n, c: "".join(rng.choice(c) for _ in range(n))
    words = [rng.choice((f"token={make(8, 'abcXYZ')}", make(30, "0123456789abcdef"), "AKIA" + make(16, "ABC123"), f"Aa1{make(20, 'abcXYZ019')}", "plain é😀")) for _ in range(125_000)]
    text = " ".join(words)
    df = spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")
    r = secret_scan.scan(df, owner=F.col("source"), repository=F.col("source")).first()
    at, want = 0, []
    for w in words:
        kind = "assign" if w[:5] == "token" else "access" if w[:4] == "AKIA" else "owned" if w[:3] == "Aa1" else "hex" if w[:5] != "plain" else None
        if kind and (kind != "owned" or any(c.isdigit() for c in w)):
            want.append(f"{kind}:{at}:{at + len(w)}")
        at += len(w) + 1
    assert len(want) > 90_000 and r.spans.split(",") == want
