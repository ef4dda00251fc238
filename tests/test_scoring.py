"""Scores at the edges of their bands, and text operators on odd texts."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from factloom.functions import scoring
from factloom.operators import retrieval, text

AS_OF = "2025-01-01"


@pytest.mark.parametrize(("days", "score"), [(0, 1.0), (365, 1.0), (366, 0.9), (730, 0.9), (1095, 0.8), (1825, 0.65), (3650, 0.5), (3651, 0.35), (None, 0.4)])
def test_rank_freshness(spark, days, score):
    date = None if days is None else datetime.date(2025, 1, 1) - datetime.timedelta(days=days)
    df = spark.createDataFrame([(date,)], "d date")
    assert df.select(scoring.rank_freshness(F.col("d"), AS_OF)).first()[0] == score


@pytest.mark.parametrize(("c", "n", "bad", "status"), [(0.9, 0, 0, "INSUFFICIENT_EVIDENCE"), (0.9, 2, 1, "CONFLICTING"), (0.75, 1, 0, "SUPPORTED"), (0.45, 1, 0, "PARTIALLY_SUPPORTED"), (0.44, 1, 0, "INSUFFICIENT_EVIDENCE")])
def test_truth_status(spark, c, n, bad, status):
    assert spark.range(1).select(scoring.truth_status(F.lit(c), F.lit(n), F.lit(bad))).first()[0] == status


def test_calculators(spark):
    row = spark.range(1).select(scoring.solar_credits(F.lit(100.0), F.lit(0.5)), scoring.methane_credits(F.lit(10.0)), scoring.biochar_credits(F.lit(12.0))).first()
    assert list(row) == pytest.approx([50.0, 252.0, 24.64])


@pytest.mark.parametrize(("question", "plan"), [("Compare A and B", "COMPARISON"), ("Is A a market?", "REASONING"), ("how are they linked", "GRAPH"), ("define A", "ONTOLOGY"), ("who", "SEMANTIC"), ("", "HYBRID")])
def test_strategy(spark, question, plan):
    assert spark.range(1).select(text.strategy(F.lit(question))).first()[0] == plan


def test_sentences_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "One. Two!  Three"), (4, "   ")], "doc_id long, text string")
    assert [(r["doc_id"], r["sentence"]) for r in text.sentences(docs).orderBy("doc_id", "pos").collect()] == [(3, "One."), (3, "Two!"), (3, "Three")]


def test_topk_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, None)], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in retrieval.vector_topk(rows, [1.0, 0.0], 2).collect()] == [1, 3]
