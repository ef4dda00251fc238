"""Odd documents that every operator must take: nulls, empty and long texts, repeated rows and clashing extra columns."""

from __future__ import annotations

import pytest

LONG = "word one two three " * 40_000
CLASHING = ["size", "fp", "score", "n_words", "kept", "u", "slice", "slot", "gumbel", "grp", "digest", "media", "file", "start", "x0", "c0_lang"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [
        (1, None, "en", "a"), (2, "", None, "a"), (3, " \t\n ", "en", None), (4, LONG, None, None), (5, "Same text here. " * 20, "en", "a"), (6, "Same text here. " * 20, "en", "a"),
        (6, "Same text here. " * 20, "en", "a"), (None, "no id <|endoftext|> Été ΑΣ ß\u3000x", "fr", "b"), (None, None, None, None), (-3, "one", "de", "b"),
    ]
    return spark.createDataFrame([(*r, *[f"x{k}" for k in range(len(CLASHING))]) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHING))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
