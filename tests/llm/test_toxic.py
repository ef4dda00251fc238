"""The classifier loses toxic rows of otherwise good text and keeps clean ones."""

from __future__ import annotations

import random

import numpy as np

from factloom.llm import quality

SLURS = ["pathetic", "trash", "clown", "moron", "scum", "loser"]


def test_toxic_rows_of_good_text_go(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(2, 8))) for _ in range(900)]
    rows, labels = [], []
    for k in range(1200):
        text, toxic, junk = rng.choices(words, k=rng.randrange(80, 400)), k % 8 == 0, k % 8 == 1
        for at in rng.sample(range(len(text)), 4) if toxic else []:
            text[at] = rng.choice(SLURS)
        rows.append((k, " ".join(f"{x}{rng.randrange(10**6)}" for x in text) if junk else " ".join(text)))
        if k % 2 == 0 or junk:
            labels.append((k, int(not junk), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = quality.verdicts(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))[0]
    kept = {r["doc_id"]: r["kept"] for r in found.collect()}
    assert np.mean([kept[k] for k in range(0, 1200, 8)]) <= 0.1
    assert np.mean([kept[k] for k in range(1200) if k % 8 > 1]) >= 0.95


def test_equal_scores_are_not_divided():
    assert quality.best_cut(np.array([0.0, 0.0, 0.0, 1.0]), np.array([0, 0, 1, 1])) == float("-inf")
