import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prefspark.llm import chunked_bpe
from prefspark.llm.pieces import byte_pieces, tokenizer_path, word_pieces
from llm_fixtures import ODD_ROWS, frame

WORD = tokenizer_path("word_bpe_49k.json")
PARTS = [*"abcdefthe  \n\t'!?.,0123456789éÉßàñ", "<|endoftext|>", " ", "́", "日本", "İ", "Σς", "'s", "'LL", "\xa0",
         "\x00", "😀", "ﬁ", "\x85", " ", "²"]
texts = st.lists(st.sampled_from(PARTS), max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_ids_equal_the_library(text):
    encoder = word_pieces(WORD)
    own = chunked_bpe.ChunkedEncoder(encoder)
    expected = encoder.library.encode(text, add_special_tokens=False).ids
    bits, chunked_bpe.CHUNK_BITS = chunked_bpe.CHUNK_BITS, 3
    try:
        ids = own.encode(text)
    finally:
        chunked_bpe.CHUNK_BITS = bits
    assert np.frombuffer(ids, "<u4").tolist() == expected
    assert encoder.decode(ids) == encoder.library.decode(expected, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_byte_ids_equal_the_library(text):
    encoder = byte_pieces(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))
    expected = encoder.library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == expected


def test_equal_passages_share_chunks_wherever_they_stand():
    rng = np.random.default_rng(0)
    passage = " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(3000))
    own = chunked_bpe.ChunkedEncoder(word_pieces(WORD))
    own.encode("one start. " + passage)
    before = own.encoded
    own.encode("quite another beginning, longer than the first. " + passage)
    assert own.reused > 5 and own.encoded - before <= 3


def test_disagreeing_join_is_noticed():
    own = chunked_bpe.ChunkedEncoder(word_pieces(WORD))
    assert own.join("wor", "ld", "") is None  # a cut inside a word: the neighbours' ids do not hold


def test_rows(spark):
    out = chunked_bpe.encode_documents(frame(spark, ODD_ROWS, extra=True)).collect()
    assert len(out) == len(ODD_ROWS)
    library = word_pieces(WORD).library
    texts = {i: t or "" for i, t, _, _ in ODD_ROWS}
    for r in out:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert chunked_bpe.encode_documents(frame(spark, [])).count() == 0


@pytest.mark.parametrize("text", ["", " ", "\n\n", "a", "a" * 5000, "ab " * 5000])
def test_edges(text):
    encoder = word_pieces(WORD)
    ids = chunked_bpe.ChunkedEncoder(encoder).encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == encoder.library.encode(text, add_special_tokens=False).ids
