"""Truth packages of hand-made evidence: the four statuses, scope by country, ties and nulls."""

from __future__ import annotations

import datetime

import pytest

from factloom.operators import verdicts

FIELDS = "answer_id long, place int, doc_id long, country string, published date, title string, source_class string, issuer string, status string, evidence_score double, semantic_score double"
DAY = datetime.date(2024, 6, 1)


def row(answer, place, doc, country="Oman", kind="government", score=0.95, status="verified", issuer=None):
    return (answer, place, doc, country, DAY, f"T{doc}", kind, issuer or f"I{doc}", status, score, score)


ROWS = [
    *[row(1, k, k) for k in range(4)], *[row(2, k, k, score=0.9) for k in range(3)], row(3, 0, 1, score=0.9), row(4, 0, 1, score=0.05, kind="news"), row(5, 0, 1, country="Oman"), row(5, 1, 2, country="UAE"), row(6, 0, 1, country="Global"),
    (8, 0, None, None, None, None, None, None, None, None, None),
]
QUESTIONS = [(1, "What is it?"), (2, "And this?"), (3, "One?"), (4, "Weak?"), (5, "What does the U.A.E. plan?"), (6, "Oman policy"), (7, "nothing found"), (8, None), (9, "Compare Omani and global targets")]


@pytest.fixture(scope="module")
def made(spark):
    evidence = spark.createDataFrame([*ROWS, row(9, 0, 1, country="Global"), row(9, 1, 2, country="Oman")], FIELDS)
    questions = spark.createDataFrame(QUESTIONS, "answer_id long, question string")
    countries = spark.createDataFrame([("United Arab Emirates", a) for a in ("uae", "u.a.e", "united arab emirates")] + [("Oman", a) for a in ("oman", "omani")], "country string, alias string")
    return evidence, questions, verdicts.scoped(evidence, questions, countries), verdicts.requested(questions, countries)


def test_countries_of_questions(made):
    assert {(r.answer_id, r.country) for r in made[3].collect()} == {(5, "United Arab Emirates"), (6, "Oman"), (9, "Oman")}


def test_scope(made):
    kept = {(r.answer_id, r.place): r.kept for r in made[2].collect()}
    assert kept[5, 0] is False and kept[5, 1] is True and kept[6, 0] is False and kept[9, 0] is True and kept[9, 1] is True and kept[1, 0] is True and kept[8, 0] is True


def test_statuses(spark, made):
    conflicts = spark.createDataFrame([(2, "x")], "answer_id long, unit string")
    found = {r.answer_id: r for r in verdicts.package(made[1], made[2].where("kept"), conflicts, "2025-01-01").collect()}
    assert [found[k].status for k in range(1, 10)] == ["supported", "conflicted", "partial_support", "insufficient_evidence", "partial_support", "no_evidence", "no_evidence", "insufficient_evidence", "supported"]
    first = found[1]
    score = 0.38 * 0.95 + 0.2 * 0.95 + 0.14 * (0.35 / 3 + 0.4 + 0.25) + 0.14 * 0.84 + 0.14
    assert first.score == pytest.approx(score, abs=1e-6) and (first.level, first.reliability, first.freshness, first.coverage) == ("very_high", "official_source", 1.0, 0.84)
    assert found[2].agreement == pytest.approx(2 / 3, abs=1e-6) and (found[7].score, found[7].level, found[7].reliability) == (0.0, "insufficient", "insufficient_evidence")


def test_summaries_and_citations(made):
    found = {r.answer_id: r for r in verdicts.summary(made[0]).collect()}
    assert (found[5].countries, found[5].classes, found[5].n_documents, found[5].highest) == ("Oman,UAE", "government:2", 2, 0.95) and (found[8].classes, found[8].countries, found[8].highest) == ("other:1", "", 0.0)
    cites = [(r.citation, r.doc_id, r.label) for r in verdicts.citations(made[0], 2).collect() if r.answer_id == 1]
    assert sorted(cites) == [("CA-001", 0, "T0 · I0 · 2024-06-01"), ("CA-002", 1, "T1 · I1 · 2024-06-01")]
    assert verdicts.citations(made[0].limit(0)).count() == 0 and verdicts.summary(made[0].limit(0)).count() == 0


def test_reports_are_made_once_for_evidence_and_questions(spark, sf_dir):
    """Before, the plan of the package made the reports anew for every part of the evidence and the questions."""
    from factloom.plans import catalog

    plan = catalog.QUERIES["fun14_truth_package"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan and "step-" in plan
