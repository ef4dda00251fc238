"""Groups and links of two tokenizers against a plain count of overlapping byte ranges."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from factloom.llm import alignment, queries
from factloom.llm.bpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BYTE = {letter: b for b, letter in enumerate(byte_letters())}


def brute(texts):
    """The result for a list of texts, from all pairs of tokens of a text."""
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    links, groups, sizes, holders = [], [], [], defaultdict(set)
    for k, text in enumerate(texts):
        links.append([])
        groups.append("")
        sizes.append((0, 0, 0))
        if not text:
            continue
        a = [(i, bytes(BYTE[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()) for i, p in ((i, second.id_to_piece(i)) for i in second.encode(text))]
        if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (a, b)):
            continue
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        named, low = [], 0
        for cut in cuts:
            named.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= cut) for side in spans))
            low = cut
        links[k] = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
        groups[k], sizes[k] = hashlib.sha256(";".join(named).encode()).hexdigest(), (len(a), len(b), len(cuts))
        for pair in links[k]:
            holders[pair].add(k)
    most = defaultdict(int)
    for (i, _), held in holders.items():
        most[i] = max(most[i], len(held))
    return [(*sizes[k], len(p), sum(len(holders[x]) == most[x[0]] for x in p), sum(len(holders[x]) for x in p), groups[k]) for k, p in enumerate(links)]


ODD = [
    "plain words, plain words", "<|endoftext|> and </s> are text", "été 漢字 😀　x", "a▁b differs", "", None, "x", " two  spaces\n\nlines\t", "plain words, plain words", "thatndou thatndou thnatndou",
    "12345 1234 123 12 1", "\x00 \x7f ​", "internationalization unfathomable plain", "the the the then the",
]


def check(spark, texts, block_bytes):
    rows = [(k, t, "clash", 1) for k, t in enumerate(texts)]
    found = alignment.aligned(spark.createDataFrame(rows, "doc_id long, text string, groups string, block long").repartition(3), A, B, block_bytes).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == dict(enumerate(brute(texts))) and len(found) == len(texts)


def test_odd_texts_in_one_block_and_in_many(spark):
    check(spark, ODD * 3, 1 << 20)
    check(spark, ODD * 3, 16)


def test_whole_documents(spark, documents):
    check(spark, [r.text[:600] for r in documents.limit(60).collect()], 3_000)


def test_pairs_in_several_groups_of_a_text_count_once():
    pair = alignment.pair_of(A, B)
    texts = ["the the then thenn the", "then thenn thennn"]
    expected = brute(texts)
    assert Counter(r[0] for r in expected)[0] == 0
    import pyarrow as pa

    a, n_a, b, _ = pair.encode(pa.array(texts))
    _, keys = pair.groups(a, b)
    group, x, y = pair.links(keys)
    assert len(group) == sum(r[3] for r in expected) and len(a) == n_a.sum() and len(x) == len(y)


def test_odd_rows(odd_docs, no_docs):
    texts = [r.text for r in odd_docs.collect() if len(r.text or "") < 10_000]
    found = alignment.aligned(odd_docs.where("text is null or length(text) < 10000"), A, B).collect()
    assert sorted((tuple(r)[1:] for r in found), key=repr) == sorted(brute(texts), key=repr)
    assert alignment.aligned(odd_docs, A, B).count() == odd_docs.count()
    assert alignment.aligned(no_docs, A, B).count() == 0


def test_query_on_documents(spark, sf_dir, documents):
    found = {r.doc_id: r for r in queries.op13_alignment(spark, sf_dir).collect()}
    rows = documents.collect()
    short = [r for r in rows if len(r.text or "") < 1_500]
    assert len(found) == len(rows)
    for r, (n_a, n_b, n_groups, n_links, _, _, digest) in zip(short, brute([r.text for r in short]), strict=True):
        own = found[r.doc_id]
        assert (own.n_a, own.n_b, own.n_groups, own.n_links, own.groups_sha256) == (n_a, n_b, n_groups, n_links, digest)
        assert own.n_best <= own.n_links <= own.count_sum
