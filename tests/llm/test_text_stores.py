"""Media, token files and BPE: exact round trips and the tokenizers library."""

from __future__ import annotations

import hashlib
import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import bpe, media, tokenfiles
from factloom.llm.shared import write_shared

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
WHICH = ["documents", "odd_docs", "no_docs"]


@pytest.fixture(autouse=True)
def quiet():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def library(path):
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("which", WHICH)
def test_media_come_back(which, request):
    docs = request.getfixturevalue(which)
    expected = []
    for doc, text in rows_of(docs):
        raw = text.encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        stored = b"P5 576 %d 255\n" % (len(payload) // 576) + payload
        expected.append(repr((doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest())))
    found = media.read_media(docs).collect()
    assert sorted(repr(tuple(r)[:-1]) for r in found) == sorted(expected)
    assert len({(r["media_sha256"], r["feature"]) for r in found}) == len({r["media_sha256"] for r in found})


def test_busy_chunks_are_salted(odd_docs):
    """With one use a copy, all shared chunks take the salted way; the result is the same."""
    recipes = write_shared(media.recipes_of(odd_docs), "t")
    store = media.chunk_store(odd_docs)
    one = {(bytes(r["media"]), tuple(map(bytes, r["parts"]))) for r in media.rebuilt(recipes, store).collect()}
    assert one == {(bytes(r["media"]), tuple(map(bytes, r["parts"]))) for r in media.rebuilt(recipes, store, uses=1).collect()}


def test_store_on_disk(spark, documents, tmp_path):
    media.write_store(documents, f"file://{tmp_path}/store")
    assert media.read_store(spark, f"file://{tmp_path}/store").count() == documents.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_cuts_follow_the_content():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 400_000, dtype=np.uint8).tobytes()
    parts, shifted = media.chunks(data), media.chunks(b"new start" + data)
    assert b"".join(parts) == data and all(media.MIN <= len(p) <= media.MAX for p in parts[:-1])
    assert len(set(parts) & set(shifted)) >= len(parts) - 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 60_000), st.integers(0, 9), st.integers(0, 2**32 - 1)), max_size=300), max_size=6))
def test_segments_round_trip(docs):
    lengths = np.array([len(d) for d in docs], np.uint32)
    ids = np.array([x for d in docs for x in d], np.uint32)
    segment = tokenfiles.pack(ids, lengths)
    back, sizes = tokenfiles.unpack(segment)
    assert back.tolist() == ids.tolist() and sizes.tolist() == lengths.tolist()
    for k, start in enumerate(tokenfiles.block_starts(segment).tolist()):  # each block alone, from its indexed start
        block = ids[128 * k : 128 * (k + 1)]
        assert tokenfiles.unpack_block(segment, start)[: len(block)].tolist() == block.tolist()


@pytest.mark.parametrize("which", WHICH)
def test_token_files(which, request):
    docs, own = request.getfixturevalue(which), library(BYTE_BPE)
    at, expected = 0, []
    digest = lambda t: 42 if t is None else int(np.uint64(xxhash.xxh64_intdigest(t, 42)).view(np.int64))
    rows = [(r["doc_id"], digest(r["text"]), r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    for doc, _, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*own.encode(text, add_special_tokens=False).ids, 2]
        expected.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    found = tokenfiles.read_documents(tokenfiles.write_ids(docs, BYTE_BPE)).collect()
    assert sorted((tuple(r) for r in found), key=lambda r: r[1]) == expected


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(" \n\t\x85\xa0\u2003\u3000ab1é×÷.,'-¿<|>", max_size=40)), max_size=8))
def test_pieces_are_the_librarys(texts):
    own = tokenfiles.encoder(BYTE_BPE)
    ids, lengths = own.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(lengths, dtype=np.int64)
    for text, n, end in zip(texts, lengths.tolist(), ends.tolist(), strict=True):
        assert ids[end - n : end].tolist() == [*own.tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_blocks_are_read_alone(spark, documents):
    """A span of the whole store's ids, from the blocks that hold it."""
    store = tokenfiles.write_ids(documents, BYTE_BPE)
    whole = [i for r in tokenfiles.read_documents(store, with_ids=True).orderBy("start").collect() for i in r["ids"]]
    for first, n in ((0, 1), (len(whole) - 5, 50), (1000, 3000), (len(whole), 3)):
        rows = tokenfiles.read_span(store, first, n).orderBy("at").collect()
        assert [i for r in rows for i in r["ids"]] == whole[first : first + n]
        assert all(len(r["ids"]) <= tokenfiles.BLOCK for r in rows)


ODD_TEXTS = ["", " ", "<|endoftext|>", "a<|startoftext|>b", "<|end<|endoftext|>", "it's we'll I'VE", "x　y\x85z\x1cq", "İI ΑΣ Σ ΣΑΣ. ſ K", "é é ﬁ 가", "12345 1,000 ٣", "👩‍👩‍👧 😀", "\x00​﻿", ":\U000323b0", "a\u088fb\U0003d000", "aaaa" * 50, "ababab" * 30, "!!!???...", "İstanbul"]


def test_bpe_on_odd_texts(spark):
    own = library(WORD_BPE)
    rows = bpe.encoded(spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string"), WORD_BPE).collect()
    for r in rows:
        ids = own.encode(ODD_TEXTS[r["doc_id"]], add_special_tokens=False).ids
        assert (r["doc_id"], r["ids"]) == (r["doc_id"], ids)
        assert r["decoded"] == own.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_on_any_text(text):
    own = _library()
    n, found, decoded = bpe.codec(WORD_BPE).encode(text)
    ids = own.encode(text, add_special_tokens=False).ids
    assert [int(x) for x in found.split()] == ids and n == len(ids)
    assert decoded == own.decode(ids, skip_special_tokens=False)


_made = []


def _library():
    if not _made:
        _made.append(library(WORD_BPE))
    return _made[0]


@pytest.mark.parametrize("which", WHICH)
def test_bpe_digests(which, request):
    docs, own = request.getfixturevalue(which), _library()
    expected = []
    for doc, text in rows_of(docs):
        ids = own.encode(text, add_special_tokens=False).ids
        expected.append(repr((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest())))
    assert sorted(repr(tuple(r)) for r in bpe.encoded(docs, WORD_BPE, texts=False).collect()) == sorted(expected)
