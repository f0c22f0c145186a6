"""Encoding against the tokenizer library, decoding as an exact round trip."""

import hashlib
import json
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tremolo.llm.bpe import Codec, Tokens, bpe_decode, bpe_encode, bpe_round_trip
from tremolo.llm.queries import op1_bpe, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both():
    with open(tokenizer_path()) as f:
        spec = f.read()
    codec, tokens = Codec(spec), Tokens(spec)
    codec.decode = lambda ids: tokens.decode([ids])[0]
    return codec, Tokenizer.from_str(spec)


def same(codec, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = codec.encode([text])[0]
    assert got == struct.pack(f"<{len(want)}I", *want), text[:80]
    assert codec.decode(got) == library.decode(want, skip_special_tokens=False)


def test_hard_cases(both):
    for text in ["", " ", "a</w> b</w>", "<|endoftext|>x<|startoftext|>", "<|endoftext|", "it's WE'LL 'S", "\x1ca\x1db", "ab" * 400, "x" * 20000, "漢字かな ﬁ é İI ß ΑΣ", "1234 5.6-7", "a\u0085b　c d"]:
        same(*both, text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, text):
    same(*both, text)


def test_query_equals_library(spark, both):
    library = both[1]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op1_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_repeats_and_clashes(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (2, "hi hi", None), (2, "hi hi", None)], "doc_id long, text string, ids string")
    rows = bpe_decode(bpe_encode(df, tokenizer_path()), tokenizer_path()).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in rows) == [(0, ""), (1, ""), (2, "hi</w> hi</w>"), (2, "hi</w> hi</w>")]
    assert sorted((r.doc_id or 0, r.decoded) for r in bpe_round_trip(df, tokenizer_path()).collect()) == [(0, ""), (1, ""), (2, "hi</w> hi</w>"), (2, "hi</w> hi</w>")]
    assert bpe_encode(df.limit(0), tokenizer_path()).count() == 0


def test_special_tokens_of_any_form(both):
    with open(tokenizer_path()) as f:
        spec = json.loads(f.read())
    spec["added_tokens"].append(spec["added_tokens"][0] | {"id": 49408, "content": "[CLS]"})
    spec = json.dumps(spec)
    codec, library = Codec(spec), Tokenizer.from_str(spec)
    for text in ["[CLS]a b[CLS]", "a[CLS", "<|endoftext|>[CLS] [cls]"]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode([text])[0] == struct.pack(f"<{len(ids)}I", *ids)
        assert Tokens(spec).decode([codec.encode([text])[0]])[0] == library.decode(ids, skip_special_tokens=False)


def test_memo_runs_full(both, monkeypatch):
    codec = both[0]
    before = codec.chunks.most
    for memo in (codec.trie.pairs, codec.trie.ends, codec.trie.starts):
        monkeypatch.setattr(memo, "most", 4)
    for most in (1, 900, 4000):
        codec.remember(most)
        for text in ["one two three", "two four five six", "one seven two eight nine ten eleven", "two two one", "a,b one,two"]:
            same(*both, text)
            assert codec.chunks.held <= max(most, 900)
    codec.remember(before)
