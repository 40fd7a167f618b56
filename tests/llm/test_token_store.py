"""Token ids in wavelet matrices: the matrix against plain arrays, files against the tokenizers library."""

import functools
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyrand.llm import queries as Q
from tallyrand.llm import token_store as T

PATH = public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def plain(text):
    return library().encode(text or "", add_special_tokens=False).ids + [2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=1500), st.integers(6, 9))
def test_matrix_against_a_list(ids, bits):
    made = T.WaveletMatrix.of(np.array(ids, np.uint16), bits)
    m = T.WaveletMatrix.from_bytes(made.n, made.zeros, made.planes.tobytes(), made.ranks.tobytes())
    assert m.decoded().tolist() == ids
    assert m.access(range(len(ids))).tolist() == ids
    for token in {ids[0], ids[-1], 7, 40, 1 << bits}:
        assert m.count(token) == ids.count(token)
        assert m.count(token, len(ids) // 2) == ids[: len(ids) // 2].count(token)
        assert m.places(token).tolist() == [i for i, x in enumerate(ids) if x == token]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aZé'ß \n\t\r ́가5,.<|>endoftx語😀İΣς")), max_size=60))
def test_encoder_as_the_library(text):
    texts = [text, "<|endoftext|> " + text, None, text.replace(" ", "") + "<|ENDOFTEXT|>, It's"]
    ids, sizes = T.encoder(PATH)(texts)
    assert [x.tolist() + [2] for x in np.split(ids, np.cumsum(sizes)[:-1])] == [plain(t) for t in texts]


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 3)
    own = T.Encoder(PATH)
    for text in ("one two three four five", "six one", "two " * 9):
        assert own([text])[0].tolist() + [2] == plain(text)
    assert [x.tolist() for x in own([])] == [[], []]


def test_op13_as_the_library(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in Q.op13_token_store(spark, SF).collect()}
    start = 0
    for d, text in docs:
        ids = plain(text)
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


@pytest.fixture()
def small(spark, monkeypatch, tmp_path):
    rows = [(5, "b b", "x"), (5, "a", "y"), (None, "null id", "z"), (2, None, "w"), (9, "", "v"), (7, "word " * 3000, "u"), (5, "b b", "x"), (8, "Ünïcode ’s", "t")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(3)
    out = f"file://{tmp_path}/{uuid.uuid4().hex}"
    T.write(frame, out, path=PATH)
    return rows, out


def test_nulls_repeats_long_and_clashing_names(spark, small):
    rows, out = small
    got = sorted(T.read(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 2, 5, 5, 5, 7, 8, 9]
    assert sorted((r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((d or 0, plain(t)) for d, t, _ in rows)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens


def test_counts_and_places(spark, small):
    _, out = small
    whole = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(T.read(spark, out).collect(), key=lambda r: r.start)])
    word = plain("word")[0]
    assert {r.token: r.n for r in T.counts(spark, out, [word, 2, 3]).collect()} == {t: int((whole == t).sum()) for t in (word, 2, 3)}
    got = sorted((r.token, r["at"]) for r in T.occurrences(spark, out, [word, 2]).collect())
    assert got == sorted((t, int(i)) for t in (word, 2) for i in np.flatnonzero(whole == t))
    assert {r.place for r in T.occurrences(spark, out, [word]).where("doc_id = 7").collect()} == set(range(3000))
    asked = [0, 5, len(whole) - 1, len(whole)]
    assert {r["at"]: r.token for r in T.tokens_at(spark, out, asked).collect()} == {i: int(whole[i]) for i in asked[:-1]}


def test_many_shards_and_segments(spark, monkeypatch, tmp_path):
    """Shards by range, also of one id: the order and the starts hold over all of them."""
    monkeypatch.setattr(T, "SHARD_BYTES", 500)
    docs = spark.range(400).selectExpr("case when id % 3 = 0 then 50 else id end as doc_id", "concat('text ', id) as text")
    out = f"file://{tmp_path}/many"
    T.write(docs, out, path=PATH)
    assert spark.read.parquet(out).select("shard").distinct().count() > 2
    got = sorted(T.read(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in docs.collect())
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()


def test_empty_table(spark, tmp_path):
    out = f"file://{tmp_path}/none"
    T.write(spark.createDataFrame([], "doc_id long, text string"), out, path=PATH)
    assert T.read(spark, out).collect() == [] and T.counts(spark, out, [5]).collect() == []
