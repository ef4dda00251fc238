"""Discovery and augmentation: scores, order of rules, ids, rejections, and that a plan applied twice adds nothing."""

from __future__ import annotations

import pytest

from factloom.operators import augmentation as a

REGISTRY = "entity_id string, name string, type string, aliases array<string>, candidates array<string>, occurrences long"
FACTS = "rel_id long, subject_id string, predicate string, object string, value_type string, confidence double, source long"
ENTITIES = [
    ("E1", "Oman", "country", ["Sultanate Policy"], None, 1), ("E7", "Green Energy Fund", "x", None, ["ENERGY_CONCEPT_WIND_ENERGY_MARKET"], 2), ("E3", "Solar Plan", "x", ["green energy fund", "wind energy market"], [], None), ("X", "Other", "x", [], [], 1),
]


def fact(k, subject, value, kind=None, confidence=0.5, source=None, predicate="builds"):
    return (k, subject, predicate, value, kind, confidence, source if source is not None else k)


ROWS = [
    *[fact(k, "E1", "green ENERGY  fund") for k in range(4)], *[fact(10 + k, "E1", "Wind energy market") for k in range(4)], *[fact(20 + k, "E7", "Sultanate policy") for k in range(4)], *[fact(30 + k, "E3", "new hydrogen project", confidence=None) for k in range(4)],
    *[fact(40 + k, "E404", "New Hydrogen Project") for k in range(2)], *[fact(50 + k, "E1", "another solar bank") for k in range(3)], fact(60, "E1", None), fact(61, "E1", "  "), fact(62, "E1", "N/A"), fact(63, "E1", "USD 5 million by 2030"),
    fact(64, "E1", "the energy plan", "Currency"), fact(65, "E1", "A policy that is whole."), fact(66, "E3", "solar plan", source=1), *[fact(70 + k, "E3", "Solar plan") for k in range(4)],
]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(ROWS, FACTS).repartition(3), spark.createDataFrame(ENTITIES, REGISTRY), spark.createDataFrame([("E7", "BUILDS", "E3", 0.1), ("E7", "BUILDS", "E1", 0.2)], "subject_id string, predicate string, object_id string, confidence double")


def test_scores_and_reasons(tables):
    found = {r.key: (r.score, r.reasons, r.eligible, r.type) for r in a.discovered(tables[0]).collect()}
    assert found["green energy fund"] == (0.84, "", True, "financial_concept") and found["sultanate policy"] == (0.84, "", True, "policy_concept")
    assert found["usd 5 million by 2030"][1] == "numeric" and found["the energy plan"][1] == "literal" and found["a policy that is whole"][1] == "sentence" and found["n a"][1] == "generic"
    assert found["the energy plan"][0] == pytest.approx(0.4 + 0.16 + 0.04 + 0.14 - 0.24) and "" not in found and len(found) == 10


def test_the_first_rule_wins_and_ids_go_on(tables):
    made = a.plan(*tables)
    found = {r.key: (r.entity_id, r.match) for r in made["mapping"].collect()}
    assert found == {
        "green energy fund": ("E7", "canonical_key"), "wind energy market": ("E7", "candidate_id"), "sultanate policy": ("E1", "alias"), "solar plan": ("E3", "canonical_key"), "another solar bank": ("E8", "new"), "new hydrogen project": ("E9", "new"),
    }
    links = {(r.subject_id, r.object_id): (r.predicate, r.confidence, r.n_facts) for r in made["relationships"].collect()}
    assert links == {("E1", "E7"): ("BUILDS", 0.42, 8), ("E3", "E9"): ("BUILDS", 0.84, 4), ("E1", "E8"): ("BUILDS", pytest.approx(0.41), 3)}
    report = {r.figure: r.n for r in made["report"].collect()}
    assert (report["facts_rejected"], report["entities_inserted"], report["relationships_skipped"], report["duplicates_alias"], report["eligible"]) == (2, 2, 1, 1, 6)


def test_applying_twice_adds_nothing(tables):
    facts, registry, edges = tables
    once = a.applied(a.plan(facts, registry, edges), registry, edges)
    again = a.plan(facts, *once)
    report = {r.figure: r.n for r in again["report"].collect()}
    assert report["entities_inserted"] == report["relationships_inserted"] == 0 and report["relationships_skipped"] == 4
    assert a.applied(again, *once)[0].count() == once[0].count() == 6 and a.applied(again, *once)[1].count() == 5


def test_merging_and_empty_tables(spark, tables):
    facts, registry, edges = tables
    more = spark.createDataFrame([("oman ", None, ["C"], 5), ("New", ["n"], None, None), (None, None, None, 1)], "name string, aliases array<string>, candidates array<string>, occurrences long")
    found = {r.key: (r.name, r.aliases, r.candidates, r.occurrences) for r in a.merged(registry, more).collect()}
    assert found["oman"] == ("Oman", ["Sultanate Policy"], ["C"], 6) and found["new"] == ("New", ["n"], [], 0) and len(found) == 5
    empty = a.plan(facts.limit(0), registry.limit(0), edges.limit(0))
    assert all(empty[k].count() == 0 for k in ("discovered", "entities", "mapping", "relationships", "rejected")) and sum(r.n for r in empty["report"].collect()) == 0
