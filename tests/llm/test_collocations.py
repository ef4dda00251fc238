"""Phrase counts from merged tries against plain counts."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import collocations as c

LOWER = {k: k + 32 for k in range(0x41, 0x5B)}


def brute(rows, least, top, share):
    """(lang, text) rows to the result, by counting every phrase."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        held = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = defaultdict(int)
        for p, a in held.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        found = []
        for p, a in held.items():
            if 100 * longer[p] >= share * a:
                continue
            low, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-low, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, at, p.decode(), -a, l, r, n[lang], -low) for at, (low, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return out


ROWS = [
    ("en", "The quick fox. the quick fox, THE QUICK fox jumps! of the of the of the of the"), ("en", None), (None, "a b a b a b a b\tc"), ("en", ""), ("de", "über die Brücke über die Brücke\nüber die"), ("en", "x y z w v x y z w v: x y z w u"),
    ("de", "ÜBER die"), (None, "é é é é é é\x0bé é"), ("en", "one" * 3000 + " two " + "one" * 3000 + " two"),
] * 3


@pytest.mark.parametrize(("least", "top", "hot", "words"), [(2, 2000, c.HOT, c.RANGE_WORDS), (3, 5, 10**6, 4), (1, 2000, 10**6, 1), (4, 3, 8, 64)])
def test_equal_to_plain_counts(spark, least, top, hot, words):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "lang string, text string, words string, f long").repartition(5)
    found = sorted(map(tuple, c.collocations(docs, least, top, 80, words, hot).collect()))
    assert found == sorted(brute(ROWS, least, top, 80))


def test_documents_with_few_occurrences(spark, documents):
    rows = [tuple(r) for r in documents.select("lang", "text").where("length(text) < 4000").collect()]
    found = sorted(map(tuple, c.collocations(documents.where("length(text) < 4000"), 5, 300, 80, 200, 10**5).collect()))
    assert found == sorted(brute(rows, 5, 300, 80))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.sampled_from(["a", "b", "ab", "é", "zz"]), min_size=2, max_size=4), st.integers(1, 9)), min_size=1, max_size=8), min_size=1, max_size=4))
def test_tries_survive_packing_and_merging(tries):
    total, bodies = Counter(), []
    for trie in tries:
        words = sorted({w for p, _ in trie for w in p}, key=str.encode)
        paths = np.array([[words.index(w) + 1 for w in p] + [0] * (4 - len(p)) for p, _ in trie])
        paths, n, _ = c.summed(paths, np.array([k for _, k in trie]))
        bodies.append(c.pack(pa.array(words, pa.large_string()), paths, n))
        for p, k in trie:
            total[tuple(p)] += k
    words, paths, n = c.merge(bodies)
    words = words.to_pylist()
    assert {tuple(words[i - 1] for i in p if i): k for p, k in zip(paths.tolist(), n.tolist(), strict=True)} == total
    found, f = c.nodes(pa.array(words), paths, n)
    below = Counter()
    for p, k in total.items():
        for depth in range(2, len(p) + 1):
            below[p[:depth]] += k
    assert {tuple(words[i - 1] for i in p if i): k for p, k in zip(found.tolist(), f.tolist(), strict=True)} == below


def test_keys_of_large_vocabularies():
    paths = np.array([[70_000, 1, 5, 0], [2, 70_000, 0, 0], [70_000, 1, 4, 9], [2, 70_000, 0, 0]])
    found, n, _ = c.summed(paths, np.ones(4, np.int64))
    assert found.tolist() == [[2, 70_000, 0, 0], [70_000, 1, 4, 9], [70_000, 1, 5, 0]] and n.tolist() == [2, 1, 1]


def test_scores_are_exact(spark):
    from pyspark.sql import functions as F

    big = 4 * 10**18
    row = spark.createDataFrame([(big, big, big + 3)], "a long, l long, r long").select(c.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()
    assert row.s == 2_000_000 * big // (2 * big + 3)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("lang", "text").collect()]
    assert sorted(map(tuple, c.collocations(odd_docs).collect())) == sorted(brute(rows, 30, 2000, 80))
    assert c.collocations(no_docs).count() == 0
