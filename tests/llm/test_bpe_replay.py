import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe_replay, queries

from .conftest import SF

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = bpe_replay.compiled(PATH, PATTERN).ranks
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_like_the_library(library):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("aab bé你 \n\t'sx1😀ee") for _ in range(rnd.randint(0, 80))) for _ in range(1500)]
    texts += ["a" * n for n in range(200)] + ["ab" * 300, " " * 500, "e" * 3000, "<|endoftext|>", "", None]
    got = bpe_replay.compiled(PATH, PATTERN).encode_texts(texts)
    assert [ids(x) for x in got] == [library.encode_ordinary(t or "") for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    model = bpe_replay.compiled(PATH, PATTERN)
    (raw,) = model.encode_texts([text])
    assert model.decode(raw) == text.encode()


def test_memo_starts_afresh(monkeypatch, library):
    model = bpe_replay.MergeReplay(bpe_replay.compiled(PATH, PATTERN).ranks, PATTERN)
    monkeypatch.setattr(bpe_replay, "MEMO_PIECES", 3)
    for text in ("one two three", "two three four five", "one", "two four", "x" * 400 + " three", "x" * 400, "five one"):
        assert ids(model.encode_texts([text])[0]) == library.encode_ordinary(text)


def test_query_against_the_library(spark, library):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    for r in queries.op7_bpe_replay(spark, SF).collect():
        text = texts.pop(r["doc_id"]) or ""
        want = library.encode_ordinary(text)
        assert tuple(r)[1:] == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert not texts


def test_ids_of_other_types_and_tokens_of_none(spark):
    rows = spark.createDataFrame([("a", [1, 2]), ("b", [1, None]), ("c", [50_000, 99_999_999]), ("d", [-1]), (None, None), ("e", [])], "doc_id string, token_ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe_replay.decode(rows, PATH, PATTERN).collect()}
    assert got["a"] and (got["b"], got["c"], got["d"]) == (None, None, None) and got[None] == got["e"] == b""
    texts = spark.createDataFrame([("x", "hello"), (None, None)], "doc_id string, text string")
    assert sorted((r["doc_id"] or "", r["n_tokens"]) for r in bpe_replay.encode(texts, PATH, PATTERN).collect()) == [("", 0), ("x", 1)]
    assert {r["doc_id"] for r in bpe_replay.round_trip(texts, PATH, PATTERN).collect()} == {"x", None}


def test_operator(spark, odd_docs, no_docs, library):
    rows = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_replay.round_trip(odd_docs, PATH, PATTERN).collect()}
    want = set()
    for r in odd_docs.collect():
        got = library.encode_ordinary(r["text"] or "")
        want.add((r["doc_id"], len(got), hashlib.sha256(np.array(got, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert rows == want
    assert bpe_replay.round_trip(no_docs, PATH, PATTERN).count() == 0
    coded = bpe_replay.encode(odd_docs, PATH, PATTERN)
    assert {bytes(r["decoded"]) for r in bpe_replay.decode(coded, PATH, PATTERN).collect()} == {(r["text"] or "").encode() for r in odd_docs.collect()}
