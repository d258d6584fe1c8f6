import hashlib
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ionloom.llm import bpe
from tests.llm.rows import none, odd

PATH = public_tokenizers.path("byte_bpe_50k.json")
PUBLIC = Tokenizer.from_file(PATH)
CODER = bpe.Encoder(bpe.load(PATH))


def _ids(text):
    return PUBLIC.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab '’sltdré \n<|endoftext>½²1٣ \x1c\x85", max_size=80))
def test_equals_the_public_library(text):
    got = CODER.encode([text])[0]
    assert list(struct.unpack(f"<{len(got) // 4}I", got)) == _ids(text)
    assert CODER.decode(got) == PUBLIC.decode(_ids(text), skip_special_tokens=False)


def test_decode_replaces_broken_bytes():
    ids = _ids("é😀")
    for cut in range(len(ids)):
        packed = struct.pack(f"<{cut}I", *ids[:cut])
        assert CODER.decode(packed) == PUBLIC.decode(ids[:cut], skip_special_tokens=False)


@pytest.mark.parametrize("cached", [3, 1 << 19])
def test_cache_and_block_sizes_change_nothing(monkeypatch, cached):
    monkeypatch.setattr(bpe, "_CACHED", cached)
    monkeypatch.setattr(bpe, "_PIECES", 40)
    coder = bpe.Encoder(bpe.load(PATH))
    texts = ["some words, some more words " * k + "<|endoftext|> tail" * (k % 2) for k in range(1, 9)]
    assert coder.encode(texts) == CODER.encode(texts)


def test_round_trip_of_awkward_rows(spark):
    rows = {r["doc_id"]: r["text"] or "" for r in odd(spark).collect() if r["doc_id"] is not None}
    got = bpe.round_trip(odd(spark), PATH).collect()
    assert len(got) == odd(spark).count()
    for r in got:
        if r["doc_id"] is None:
            continue
        ids = _ids(rows[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        text = PUBLIC.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_encode_then_decode(spark):
    coded = bpe.encode(odd(spark), PATH)
    for r in bpe.decode(coded, PATH).select("text", "decoded", "n_tokens", "token_ids").collect():
        assert r["decoded"] == (r["text"] or "") and r["n_tokens"] == len(r["token_ids"])
    assert bpe.encode(none(spark), PATH).count() == 0
    assert bpe.decode(bpe.encode(none(spark), PATH), PATH).count() == 0
