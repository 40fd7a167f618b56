"""The pipeline's stages: each against a plain version over the smallest tables, and all of them over awkward rows."""

import base64
import math

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from conftest import SF
from pyspark.sql import functions as F

from tallyrand.llm import queries as Q
from tallyrand.llm import toxicity


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_take_effect(spark, docs):
    for (name, stage), kept in zip(P.STAGES[:4], (
        {r.doc_id for r in Q.op2_toxicity(spark, SF).collect() if not r.toxic},
        None,
        {r.component_id for r in Q.op5_jaccard_join(spark, SF).collect()},
        set(ids(docs)) - {r.doc_id for r in Q.op3_decontaminate(spark, SF).collect()},
    ), strict=True):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        if kept is not None:
            assert ids(out) == sorted(kept), name


def test_toxic_stage_against_the_plain_chain(spark, docs):
    """The stage's rows are those that a chain of numbers, applied text by text, leaves."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    chain = toxicity.fit(docs, labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic"), ["low_quality", "toxic"])
    left = []
    for r in docs.collect():
        terms, p = {x for w in regex.findall(r"\p{L}+", (r.text or "").lower()) for x in (w, "^" + w[:4])}, []
        for weights, earlier, constant in zip(chain.weights, chain.earlier, chain.constants, strict=True):
            z = constant + sum(w for t, w in zip(chain.terms, weights, strict=True) if t in terms) + sum(w * q for w, q in zip(earlier, p, strict=True))
            p.append(1 / (1 + math.exp(-z)))
        if not terms or p[1] < chain.thresholds[1]:
            left.append(r.doc_id)
    assert 0 < len(left) < docs.count() and ids(P.toxic(spark, docs, SF)) == sorted(left)


def test_token_stage_against_tiktoken(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in P.tokens(spark, docs, SF).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(texts[r.doc_id] or "") and r.whole


def test_line_stage(spark):
    rows = [(i, f"Shared by all sites.\nown {i}", "en", f"s{i}", 30) for i in range(11)] + [(11, "Shared by all sites.", "en", "s11", 20), (12, "", "en", "s1", 0)]
    out = {r.doc_id: r for r in P.repeated_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()}
    assert out[0].text == rows[0][1] and out[1].text == "own 1" and out[1].n_chars == 5
    assert 11 not in out and out[12].text == ""


def test_awkward_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the same words here again and again", "en", "s", 35), (3, "the same words here again and again", "en", "s", 35), (4, "the same words here again and again", None, "t", 35), (None, "no id at all", "en", None, None), (5, "word " * 20000, "en", "s", 100000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({c: F.lit("clash") for c in ("token", "node", "toxic", "words", "n_lines", "label", "ids", "found")})
    for name, stage in P.STAGES[:4]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        kept = sorted(map(str, ids_or_null(out)))
        assert kept == sorted(map(str, [1, 2, 3, None, 5] if name == "n-gram Jaccard join" else [1, 2, 3, 3, 4, None, 5])), name
        assert stage(spark, df.limit(0), SF).count() == 0, name
    last = P.tokens(spark, df, SF)
    assert last.where("not whole").count() == 0 and last.count() == 7
    assert P.tokens(spark, df.limit(0), SF).count() == 0


def test_rows_of_one_id_are_decided_one_by_one(spark):
    """Two unlike texts of one id, a copy of one under a smaller id, and contaminated rows without an id or with a clean row's."""
    first, second, other = (" ".join(f"{c}{k}" for k in range(20)) for c in "abc")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").orderBy("item_id").first().text
    make = lambda rows: spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = lambda stage, rows: sorted(((r.doc_id, r.text) for r in stage(spark, make(rows), SF).collect()), key=str)
    assert left(P.near_duplicates, [(5, first), (5, second), (3, first), (7, second), (8, other), (8, other)]) == [(3, first), (5, second), (8, other)]
    assert left(P.near_duplicates, [(5, first), (5, second)]) == [(5, first), (5, second)]
    assert left(P.benchmark, [(None, item), (None, first), (5, item), (5, second), (6, other)]) == [(5, second), (6, other), (None, first)]


def ids_or_null(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_run(spark, docs):
    out = P.run(spark, SF)
    got = {r.doc_id: r for r in out.collect()}
    assert 0 < len(got) < docs.count() and all(r.whole for r in got.values())
    toxic = {r.doc_id for r in Q.op2_toxicity(spark, SF).collect() if r.toxic}
    assert not toxic & set(got)
