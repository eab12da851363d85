import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brindle.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
OURS, THEIRS = bpe.load(PATH), Tokenizer.from_file(PATH)
CASES = ["", " ", "Hello  World's don't I'LL", "<|endoftext|>a<|startoftext|>b", "\x1c\x1da\x1fb\x85c\xa0d", "ΑΣ ΑΣ.", "x́ é É", "日本語 ١٢٣ ²", "a" * 5000, "!?" * 3000, "İstanbul", " ​﻿"]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    ids = THEIRS.encode(text, add_special_tokens=False).ids
    assert OURS.encode(text) == ids
    assert OURS.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8", max_codepoint=0x2FFF), max_size=60))
def test_any_text(text):
    assert OURS.encode(text) == THEIRS.encode(text, add_special_tokens=False).ids


def test_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").selectExpr("doc_id", "text", "1 AS n_tokens", "2 AS ids")
    rows = bpe.encode(docs, PATH).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = THEIRS.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(THEIRS.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "a"), (2, "")], "doc_id long, text string")
    rows = {(r.doc_id, r.n_tokens) for r in bpe.encode(docs, PATH).collect()}
    assert rows == {(1, 0), (None, 1), (2, 0)}
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_code_points():
    """Where scripts lie: as a letter, number or other, in lower case, and as a mark among marks."""
    spans = [(0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x17000), (0x187F0, 0x19200), (0x1A000, 0x20000), (0x2B730, 0x2B740), (0x323A8, 0x323C0), (0x33470, 0x33480)]
    points = [chr(c) for a, b in spans for c in range(a, b)]
    for form in (":{}", "{}1", "a\u0345{}\u0334", "\U00011935{}"):
        texts = [form.format(c) for c in points]
        theirs = THEIRS.encode_batch(texts, add_special_tokens=False)
        assert [t for t, e in zip(texts, theirs, strict=True) if OURS.encode(t) != e.ids] == []
