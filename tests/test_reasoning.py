"""Evidence streams to truth status on hand-made records."""

from __future__ import annotations

import pytest

from factloom.operators import reasoning

FIELDS = "question_id long, stream string, ord long, source_type string, subject string, predicate string, object string, polarity string, negated boolean, confidence double, document_id string, relationship_id string, rule string"


def record(q, stream, k, subject="S", predicate="is a", value="O", confidence=None, polarity=None, negated=None, source=None, doc=None):
    return (q, stream, k, source, subject, predicate, value, polarity, negated, confidence, doc, None, None)


ROWS = [
    record(1, "document_evidence", 2, confidence=0.8, doc="D1"), record(1, "retrieved_chunks", 9, subject="s ", predicate="Is-A", value="o", confidence=0.3, doc="d1"), record(1, "graph_evidence", 1), record(1, "ontology_evidence", 1, confidence=7.0), record(1, "unknown", 1),
    record(2, "document_evidence", 1, predicate="supports", confidence=0.9), record(2, "document_evidence", 2, predicate="opposes", confidence=0.9), record(2, "inferred_evidence", 1, predicate="supports", value="X"),
    record(3, "document_evidence", 1, predicate="located in", confidence=0.6), record(3, "document_evidence", 2, predicate="located in", value="P", confidence=0.5), record(3, "graph_evidence", 3, predicate="not located in", value="Q", polarity="Affirms", confidence=0.2),
    record(4, "document_evidence", 1, confidence=0.3), record(5, "document_evidence", 1, confidence=0.6, source="graph", negated=True), record(6, "inferred_evidence", 1),
]
PLANS = [(1, "HYBRID"), (2, "SEMANTIC"), (3, "GRAPH"), (4, "ONTOLOGY"), (5, "SEMANTIC"), (6, "GRAPH"), (7, "HYBRID")]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, FIELDS), spark.createDataFrame(PLANS, "question_id long, strategy string")


def test_records(raw):
    found = {(r.question_id, r.seq.stream, r.seq.ord): r for r in reasoning.normalised(raw[0]).collect()}
    assert len(found) == len(ROWS) - 1
    first, graph, onto = found[1, 0, 9], found[1, 2, 1], found[1, 5, 1]
    assert (first.predicate, first.subject, graph.confidence, onto.confidence, onto.source) == ("IS_A", "s", 1.0, 1.0, "ONTOLOGY")
    against = found[2, 1, 2]
    assert (against.predicate, against.raw_predicate, against.polarity) == ("SUPPORTS", "OPPOSES", "NEGATES") and found[3, 2, 3].polarity == "AFFIRMS"
    assert (found[5, 1, 1].source, found[5, 1, 1].polarity) == ("GRAPH", "NEGATES")


def test_plans_and_keys(raw):
    found = reasoning.collected(reasoning.planned(reasoning.normalised(raw[0]), raw[1])).collect()
    kept = {}
    for r in found:
        kept.setdefault(r.question_id, []).append((r.rank, r.seq.stream, r.seq.ord))
    assert {q: sorted(v) for q, v in kept.items()} == {1: [(1, 2, 1), (2, 5, 1), (3, 0, 9)], 2: [(1, 1, 1), (2, 1, 2)], 3: [(1, 1, 1), (2, 1, 2), (3, 2, 3)], 4: [(1, 1, 1)], 5: [(1, 1, 1)]}


def test_verdicts(raw):
    found = {r.question_id: r for r in reasoning.reasoned(*raw).collect()}
    mean = (0.98 * 1 + 0.95 * 1 + 1.0 * 0.3) / (0.98 + 0.95 + 1.0)
    assert found[1].confidence == pytest.approx(mean, abs=1e-6) and found[1].status == "SUPPORTED" and found[1].lines[0] == "GRAPH S IS_A O."
    assert (found[2].status, found[2].n_conflicts, found[2].confidence) == ("CONFLICTING", 1, pytest.approx(0.9 * 0.45)) and found[2].lines[-1] == "Conflict: S SUPPORTS O."
    assert (found[3].status, found[3].lines[-1]) == ("CONFLICTING", "Conflict: S LOCATED_IN multiple objects.")
    assert [found[k].status for k in (4, 5, 6, 7)] == ["INSUFFICIENT_EVIDENCE", "PARTIALLY_SUPPORTED", "INSUFFICIENT_EVIDENCE", "INSUFFICIENT_EVIDENCE"] and found[7].n_evidence == found[6].n_evidence == 0
    assert reasoning.reasoned(raw[0].limit(0), raw[1]).where("n_evidence > 0").count() == 0 and reasoning.reasoned(raw[0], raw[1].limit(0)).count() == 0
