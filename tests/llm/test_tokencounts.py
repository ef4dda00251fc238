"""Token counts from spliced chunks against the library on whole texts."""

from __future__ import annotations

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factloom.llm import queries, tokencounts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
parts = st.sampled_from(["a", " ", "  ", "\n", "don't", "1234", "été", "　", "漢字", "<|endoftext|>", "<|endof", "text|>", "!?", " x", "😀", " the"])


def count(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def by_chunks(text, step, overlap):
    """The number of tokens from chunks, or None where neighbours have no common boundary."""
    own = tokencounts.encoder(PATH)
    total, before = 0, None
    for _, start, last, body in tokencounts.pieces(text.encode(), step, overlap):
        e = own.tokenizer.encode(body.decode(), add_special_tokens=False)
        places, counts = tokencounts.boundaries(e, own.length)
        here = {int(p) + start: int(n) for p, n in zip(places, counts, strict=True)}
        if before is not None:
            common = [p for p in before if p in here and p <= start + overlap + 3]
            if not common:
                return None
            total += before[min(common)] - here[min(common)]
        if last:
            return total + len(e.ids)
        before = {p: n for p, n in here.items() if p >= start + len(body) - overlap - 3 and p + 21 <= start + len(body)}


@settings(max_examples=400, deadline=None)
@given(st.lists(parts, max_size=60).map("".join), st.integers(24, 40))
def test_a_splice_never_miscounts(text, overlap):
    found = by_chunks(text, overlap + 3, overlap)
    assert found is None or found == count(text)


def test_splices_happen():
    text = "Some words, and 12 numbers; don't stop. " * 50
    assert by_chunks(text, 64, 48) == count(text)


@pytest.fixture(scope="module")
def huge(spark):
    texts = [
        "Some words, and 12 numbers; don't stop. " * 300, "x" * 9_000, "<|endoftext|>" * 700, "words " * 40 + "y" * 3_000 + " words" * 400, "漢字 été 😀　" * 400, " " * 5_000 + "z", "", None,
        "Some words, and 12 numbers; don't stop. " * 300, "short one", "\n\n \t" * 900, "ab<|endof" * 300, "12345678901234567890" * 200,
    ]
    rows = [(k if k != 3 else None, t, "clash", 7) for k, t in enumerate(texts)] + [(0, texts[0], "clash", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, n_bytes long")


@pytest.mark.parametrize(("step", "overlap"), [(64, 64), (100, 40), (1024, 64)])
def test_counts_are_the_librarys(spark, huge, step, overlap):
    found = sorted(map(tuple, tokencounts.counted(huge, PATH, 100, step, overlap).collect()), key=repr)
    expected = [(r.doc_id, len((r.text or "").encode()), count(r.text), count(r.text) > 100) for r in huge.collect()]
    assert found == sorted(expected, key=repr)


def test_long_runs_are_widened(spark, huge):
    texts = huge.where("doc_id = 1").selectExpr("'d' AS digest", "text")
    assert [r.joined for r in tokencounts.spliced(texts, PATH, 64, 64).collect()] == [False]
    assert [r.joined for r in tokencounts.spliced(texts, PATH, 16_384, 512).collect()] == [True]


def test_odd_rows(odd_docs, no_docs):
    found = tokencounts.counted(odd_docs, PATH, step=4096, overlap=128).collect()
    expected = [(r.doc_id, len((r.text or "").encode()), count(r.text), count(r.text) > 1024) for r in odd_docs.collect()]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert tokencounts.counted(no_docs, PATH).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        tokencounts.check(public_tokenizers.path("word_bpe_49k.json"))


def test_query_on_documents(spark, sf_dir, documents):
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op12_token_counts(spark, sf_dir).collect()}
    assert found == {r.doc_id: (len((r.text or "").encode()), count(r.text), count(r.text) > 1024) for r in documents.collect()}
