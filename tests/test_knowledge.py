"""The hybrid graph of hand-made statements, comparisons of facts, and amounts in statements."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.operators import comparison, knowledge

FIELDS = "rel_id long, subject_id string, predicate string, object string, object_id string, confidence double, source long"
ROWS = [
    (3, "E1", "Builds", " Wind  Park", None, 0.5, 1), (1, "E1", "builds ", "wind park", None, 1.0, 1), (2, "E1", "builds", "WIND park", "", None, 2), (4, "E1", "supports", "Oman", "E2", 0.4, 5), (5, "E2", "supports", "Oman Co", "E1", 0.2, 5), (6, None, "x", "y", None, 1.0, 1),
    (7, "E1", "x", None, None, 1.0, 1), (8, "E9", "has", "wind park", None, 0.3, 4), (9, "E2", "knows", "gone", "E404", 0.3, 4),
]
ENTITIES = [("E1", "Alpha Energy"), ("E2", "Oman")]


@pytest.fixture(scope="module")
def made(spark):
    rows = spark.createDataFrame(ROWS, FIELDS)
    return rows, knowledge.edges_of(rows), spark.createDataFrame(ENTITIES, "entity_id string, name string")


def test_edges_and_nodes(made):
    found = {(r.source_node, r.predicate, r.target_node): (r.edge, r.object, r.occurrences, r.average, r.n_sources, r.is_literal) for r in made[1].collect()}
    assert found["E1", "builds", "OBJECT::wind park"] == (1, "wind park", 3, 0.5, 2, True) and found["E1", "supports", "E2"][5] is False and len(found) == 5
    assert {(r.node, r.value, r.n_edges) for r in knowledge.object_nodes(made[1]).collect()} == {("OBJECT::wind park", "wind park", 2)}
    assert {r.predicate: (r.n_edges, r.n_literal, r.occurrences) for r in knowledge.snapshot(made[1]).collect()}["supports"] == (2, 0, 2)


def test_hops_and_evidence(made):
    near = {(r.node, r.other, r.name, r.direction) for r in knowledge.neighbours(made[1], made[2]).collect()}
    assert ("E1", "E2", "Oman", "outgoing") in near and ("E2", "E404", None, "outgoing") in near and ("E404", "E2", "Oman", "incoming") in near and len(near) == 6
    assert {(r.path_id, r.end) for r in knowledge.one_hop(made[1], made[2], literal_only=True).collect()} == {("E1::1", "OBJECT::wind park")}
    assert sorted(r.rel_id for r in knowledge.evidence(made[1], made[0]).where("edge = 1").collect()) == [1, 2, 3]


def test_relevant_facts(spark, made):
    asked = spark.createDataFrame([("E1", "Wind park builds?"), ("E2", None), ("E5", "x")], "entity_id string, question string")
    found = [(r.entity_id, r.rank, r.edge, r.relevance, r.score) for r in knowledge.relevant_facts(made[1], asked, made[2], most=1).orderBy("entity_id").collect()]
    assert found == [("E1", 1, 1, 1.0, pytest.approx(0.45 * 0.5 + 0.35 + 0.1 + 0.1)), ("E2", 1, 9, 1.0, pytest.approx(0.45 * 0.3 + 0.35 + 0.1 / 3 + 0.05, abs=1e-6))]


def test_paths_as_text(spark):
    row = spark.createDataFrame([(["A", "B"], ["IS_A"]), (["A"], [])], "n array<string>, p array<string>").select(knowledge.formatted(F.col("n"), F.col("p")).alias("t")).collect()
    assert [r.t for r in row] == ["A\n    │\n IS_A\n    │\nB", "A"]


@pytest.mark.parametrize(
    ("given", "made"),
    [
        ("costs USD 2.5 million a year", "costs USD 2500000a year"), ("$3bn", "USD 3000000000"), ("40 percent, 5 per cent", "40%, 5%"), ("30 MW by 2030", "30 MW by 2030"), ("€ 1,500.5", "EUR 1500.5"), ("", ""),
    ],
)
def test_amounts(given, made):
    assert comparison.with_amounts(given) == made


def test_the_stronger_fact_stays_and_gaps_show(spark):
    rows = [("Oman", "The wind park shall grow to 40 percent.", 0.5, 0.5, 1), ("Oman", "Wind park will grow to 40%!", 0.9, 0.1, 2), ("Oman", "A solar plant of 30 MW by 2030.", None, None, 1), ("UAE", "An industry plan of 5 GW exists.\nshort", 0.9, 0.9, 3), (None, "No entity has this sentence here.", 1.0, 1.0, 4), ("UAE", None, 1.0, 1.0, 5)]
    df = spark.createDataFrame(rows, "entity string, content string, evidence_score double, semantic_score double, doc_id long")
    one = comparison.merged(comparison.facts(df))
    wind = one.where("topic = 'wind_capacity'").collect()
    assert len(wind) == 2  # an end mark that is no full stop goes from the fingerprint, a full stop stays
    cells = {(r.entity, r.topic): r for r in comparison.matrix(one).collect()}
    assert set(cells) == {(e, t) for e in ("Oman", "UAE") for t in ("wind_capacity", "solar_capacity", "industry")}
    assert (cells["Oman", "wind_capacity"].strength, cells["Oman", "wind_capacity"].statement, cells["Oman", "wind_capacity"].numbers) == (58, "Wind park will grow to 40%!", "40%")
    assert (cells["UAE", "solar_capacity"].has_evidence, cells["UAE", "solar_capacity"].n_facts, cells["UAE", "solar_capacity"].statement) == (False, 0, None) and cells["Oman", "solar_capacity"].numbers == "2030,30 MW"
    found = {r.topic: (r.n_with, r.complete, r.partial, r.missing) for r in comparison.gaps(comparison.matrix(one, ["Oman", "Iran"])).collect()}
    assert found == {"solar_capacity": (1, False, True, "Iran"), "wind_capacity": (1, False, True, "Iran")}
    assert comparison.matrix(one.limit(0)).count() == 0


def test_equal_words_are_one_before_they_are_normalised(spark, monkeypatch):
    rows = [("A", "solar", s, e, 0.5, d, 0) for d, (s, e) in enumerate([("Adds 5 percent of solar.", 0.2), ("Adds 5 percent of solar.", 0.9), ("Adds 5% of solar.", 0.9), ("Adds 5 percent of solar.", 0.9), ("adds 5%  of the solar", 0.1)])]
    found = spark.createDataFrame(rows * 3, "entity string, topic string, statement string, evidence_score double, semantic_score double, doc_id long, nth int")
    df = comparison.merged(found)
    nodes = df._jdf.queryExecution().optimizedPlan().toString()
    assert nodes.index("ArrowEvalPython") < nodes.rindex("Aggregate")  # an aggregate stands below the function
    kept = {r.fingerprint: (r.statement, r.n_merged, r.documents, tuple(r.first), round(r.strength, 9)) for r in df.collect()}
    assert kept == {"adds 5% of solar.": ("Adds 5% of solar.", 12, [0, 1, 2, 3], (0, 0), 0.74), "adds 5% of solar": ("adds 5% of the solar", 3, [4], (4, 0), 0.26)}
    sizes, real = [], comparison.written
    monkeypatch.setattr(comparison, "written", lambda one: sizes.append(1) or real(one))
    assert [(r.n_facts, r.n_documents) for r in comparison.matrix(df).collect()] == [(2, 5)] and sizes == [1]
