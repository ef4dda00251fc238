"""The pipeline's near-dedup stage against all pairs of 5-word shingle sets, planted near copies and odd rows."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import numpy as np
import pytest
from test_selection import WORD

from factloom.llm import nearcopies

DOCS = "doc_id long, text string, size string"


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_first(texts):
    """The least id of each component of {id: text}, by comparing all pairs."""
    sets, root = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0:
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {top(d) for d in ids}


def planted():
    rng, texts = random.Random(4), {}
    common = " ".join(f"c{k}" for k in range(40))
    for _ in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        for _ in range(rng.randrange(1, 8)):
            edited = list(words)
            for at in rng.sample(range(len(words)), rng.randrange(0, len(words) // 25 + 2)):
                edited[at] = f"e{rng.randrange(5000)}"
            texts[len(texts)] = " ".join(edited) + (" " + common if rng.random() < 0.5 else "")
    words = [f"h{k}" for k in range(200)]
    for k in range(120):  # a crowd, part of which is similar only through others
        edited = list(words)
        for at in rng.sample(range(200), rng.randrange(1, 9)):
            edited[at] = f"x{k}"
        texts[len(texts)] = " ".join(edited)
    return texts


@pytest.mark.parametrize("which", ["planted", "documents"])
def test_stage_finds_all_near_copies(spark, sf_dir, which, request):
    texts = planted() if which == "planted" else {r["doc_id"]: r["text"] for r in request.getfixturevalue("documents").collect()}
    docs = spark.createDataFrame([(d, t, "s") for d, t in texts.items()], DOCS)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()) == sorted(brute_first(texts))


def test_rows_not_ids_are_dropped(spark, sf_dir, odd_docs, no_docs):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, b), (None, a), (None, c), (None, c), (3, c + " end"), (4, None), (5, " "), (6, "A b"), (7, "a B"), (7, "a B")]
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(*r, "s") for r in rows], DOCS), sf_dir).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left if r["doc_id"] != 4) == [(1, a), (1, b), (3, c + " end"), (6, "A b")]
    assert len(left) == 5
    assert corpus_pipeline.near_dedup(spark, odd_docs, sf_dir).columns == odd_docs.columns
    assert corpus_pipeline.near_dedup(spark, no_docs, sf_dir).count() == 0


def test_similar_small_sets_share_a_key_under_any_ranks():
    rng = np.random.default_rng(3)
    for _ in range(2000):
        ranks = rng.integers(0, 256, nearcopies.BUCKETS // 64, dtype=np.uint8).repeat(64)
        n = int(rng.integers(1, 100))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        changed = int(rng.integers(0, max(1, n // 9 + 1)))
        b = np.unique(np.concatenate([a[changed:], rng.integers(0, 1 << 63, changed, dtype=np.uint64)]))
        if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
            assert len(np.intersect1d(nearcopies.keys_of(a, ranks), nearcopies.keys_of(b, ranks)))
