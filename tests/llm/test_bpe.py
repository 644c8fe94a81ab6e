"""BPE encoding and decoding against the tokenizers library."""

import hashlib
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quaywork.llm.bpe import TrieBpe, bpe_decode, bpe_encode, bpe_round_trip

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    (1, "Hello world, it's the CAT's 12 hats!  two  spaces\tand tab"),
    (2, None),
    (3, ""),
    (4, " \n "),
    (5, "Ünïcode Straße ΣΑΣ İstanbul 中文字 \u00a0 e\u0301 \u2003 \U0001f600\x00"),
    (6, "<|startoftext|>a<|endoftext|>b <|endoftext|><|startoftext"),
    (7, "supercalifragilisticexpialidocious" * 30 + " " + "long " * 20_000),
    (1, "Hello world, it's the CAT's 12 hats!  two  spaces\tand tab"),
    (None, "null id"),
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def ours():
    return TrieBpe(PATH)


def test_round_trip_digests(spark, library):
    docs = spark.createDataFrame([(i, t, 1) for i, t in TEXTS], "doc_id long, text string, ids int")
    got = sorted(map(tuple, bpe_round_trip(docs, PATH).collect()), key=str)
    want = []
    for doc_id, text in TEXTS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw, decoded = struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_ids_and_texts(spark, library):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    coded = bpe_encode(docs, PATH)
    assert sorted((str(r.doc_id), r.ids) for r in coded.collect()) == sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t in TEXTS)
    texts = {r.doc_id: r.text for r in bpe_decode(coded, PATH).collect()}
    assert texts[4] == "" and texts[5] == library.decode(library.encode(dict(TEXTS)[5], add_special_tokens=False).ids, skip_special_tokens=False)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_encode(docs, PATH).count() == 0 and bpe_round_trip(docs, PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, ours, text):
    assert ours.encode(text) == library.encode(text, add_special_tokens=False).ids
