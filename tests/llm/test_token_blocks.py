from __future__ import annotations

import uuid
import zlib
from functools import cache

import awkward
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from surveyframe.llm import token_blocks, tokenizing
from surveyframe.plans.store import folder

PATH = public_tokenizers.path("word_bpe_49k.json")


@cache
def plain() -> Tokenizer:
    return Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700),
       st.floats(0.01, 1.0), st.integers(0, 700), st.integers(0, 700))
def test_blocks_round_trip(ids, percentile, low, high):
    payload = token_blocks.pack(np.array(ids, np.uint32), percentile)
    assert token_blocks.unpack(payload).tolist() == ids
    assert token_blocks.unpack(payload, low, high).tolist() == ids[low:high]


def test_outliers_do_not_widen_a_block():
    ids = np.array([7, 8, 9, 10] * 64, np.uint32)
    plain = len(token_blocks.pack(ids))
    ids[100] = 2**31
    assert len(token_blocks.pack(ids)) == plain + 6


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text("aé'sß \t\n.,19<|>endoftx ́", max_size=60))
def test_words_encode_as_whole_texts(text):
    whole = plain().encode(text, add_special_tokens=False).ids
    assert np.frombuffer(b"".join(tokenizing.encoder(PATH).encode(text)), "<u4").tolist() == whole


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aé'sßtmdrevl \t\n.,19|İÀ\x1c<", max_size=40) | st.text(max_size=20), max_size=8))
def test_texts_encode_together_as_alone(texts):
    found = [np.frombuffer(b"".join(parts), "<u4").tolist()
             for parts in tokenizing.encoder(PATH).encode_all(texts)]
    assert found == [plain().encode(t, add_special_tokens=False).ids for t in texts]


def test_a_token_is_looked_up_once_for_many_texts():
    class Counting(dict):
        n = 0

        def __getitem__(self, token):
            Counting.n += 1
            return super().__getitem__(token)

    encoder = tokenizing.Encoder(PATH)
    texts = [f"The cat's cats aren't 7{'!' * (i % 2)}" for i in range(1_000)]
    expected = [b"".join(encoder.encode(t)) for t in texts]
    encoder.tokens = Counting(encoder.tokens)
    assert [b"".join(parts) for parts in encoder.encode_all(texts)] == expected
    assert Counting.n == 8  # the, cat, 's, cats, aren, 't, 7, !


@pytest.mark.parametrize("width", [0, 1, 7, 8, 13, 25, 26, 31, 32])
@pytest.mark.parametrize("n", [1, 8, 13, 256])
def test_bits_are_packed_as_numpy_packs_them(width, n):
    values = np.random.default_rng(width).integers(0, 2**32, (5, n), np.uint32)
    bits = ((values[:, :, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)
    packed = token_blocks._pack_bits(values, width)
    assert (packed == np.packbits(bits.reshape(5, -1), axis=1, bitorder="little")).all()
    assert (token_blocks._unpack_bits(packed, n, width) == values.astype(np.uint64) % 2**width).all()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_documents_are_read_back(spark, name):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    token_blocks.write_tokens(
        awkward.documents(spark), path, public_tokenizers.path(name), segment_ids=300)
    found = token_blocks.read_documents(spark, path).orderBy("start").collect()
    expected = []
    for i, text, _ in awkward.texts():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        expected.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in found), key=key) == sorted(
        expected, key=key)
    assert [r.doc_id or -99 for r in found] == sorted(r.doc_id or -99 for r in found)
    start = 0
    for row in found:
        assert row.start == start
        start += row.n_tokens
    runs = token_blocks.read_runs(spark, path).collect()
    assert sum(len(r.ids) for r in runs) == start
    assert max(r.before for r in runs) > 0  # a long text lies in several segments


def test_empty_table(spark):
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    token_blocks.write_tokens(awkward.documents(spark, []), path, PATH)
    assert token_blocks.read_documents(spark, path).count() == 0


def test_without_end_id_every_document_stays(spark):
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    docs = awkward.documents(spark, [(1, "", "a"), (2, "b c", "a"), (3, None, "a")])
    token_blocks.write_tokens(docs, path, PATH, end_id=None)
    found = token_blocks.read_documents(spark, path).orderBy("doc_id").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in found] == [(1, 0, 0), (2, 0, 2), (3, 2, 0)]
