import json
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from tidewell.llm import bpe

HAVE = os.path.exists(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not HAVE, reason="no vocabulary files")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_like_the_library(library, text):
    assert bpe.encoder("byte_bpe_50k")([text]) == [library(text)]


def test_batches_long_and_special_texts(library, monkeypatch):
    rnd = random.Random(0)
    texts = ["".join(rnd.choice("aAb \n\t'.s0é中😀​_-tlhe") for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    texts += ["<|endoftext|> a <|endoftext|>", "a" * 50_000, "aaab" * 5_000, "", " ", "\r\n" * 100, "the cat " * 3000]
    encode = bpe.encoder("byte_bpe_50k")
    want = [library(t) for t in texts]
    assert [list(x) for x in encode(texts)] == want
    monkeypatch.setattr(bpe, "LONG_TEXT", 500)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    assert [list(x) for x in encode(texts)] == want


def test_ranks_are_applied_in_order(tmp_path):
    vocab = {c: i for i, c in enumerate(bpe.byte_symbols())}
    merges = [("b", "c"), ("a", "b"), ("ab", "c"), ("a", "bc")]
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    path = tmp_path / "own.json"
    path.write_text(json.dumps({"model": {"vocab": vocab, "merges": [" ".join(m) for m in merges]}, "pre_tokenizer": {"type": "ByteLevel"}}))
    e = bpe.PairBPE(str(path))
    assert e.encode(["abc", "ab", "aabb"]) == [[vocab["abc"]], [vocab["ab"]], [vocab["a"], vocab["ab"], vocab["b"]]]


def test_other_kinds():
    for name in ("byte_bpe_multi_50k", "word_bpe_49k", "piece_bpe_32k"):
        a, b, c = bpe.encoder(name)(["Hello world", None, ""])
        assert a and b == [] and c == []
    with pytest.raises(FileNotFoundError):
        bpe.encoder("none")


def test_corpus(spark, library):
    df = spark.createDataFrame([(1, "Hello world", 5), (2, None, 5), (3, "", 5), (4, " \n", 5), (4, " \n", 5), (None, "x", 5)], "doc_id bigint, text string, ids int").selectExpr("*", "1 key", "2 n_tokens")
    got = bpe.encode_corpus(df)
    assert got.schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
    want = {1: library("Hello world"), 2: [], 3: [], 4: library(" \n"), None: library("x")}
    found = [(r.doc_id, r.ids) for r in got.collect()]
    assert len(found) == 6 and all(want[k] == v for k, v in found)
    assert dict(rows(bpe.token_counts(df.filter("doc_id is not null")))) == {k: len(v) for k, v in want.items() if k}
    assert bpe.encode_corpus(df.limit(0)).collect() == []


def test_round_trip(spark):
    docs = spark.createDataFrame([(1, "Hello  wörld\r\n\t<|endoftext|> 温度 🙂"), (2, None), (3, ""), (1, "\u0000​ x")], "doc_id bigint, text string")
    assert sorted(map(tuple, bpe.round_trip(docs).collect())) == [(1, True), (1, True), (2, True), (3, True)]
