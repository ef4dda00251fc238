"""Propositions of hand-made texts: carried subjects and predicates, lists, protected phrases, values, confidence."""

from __future__ import annotations

import pytest

from factloom.operators import propositions

TEXTS = [
    (1, "The strategy supports solar, wind and hydrogen; aims to reduce costs by 40 percent by 2030; with new meters. It is late."),
    (2, "Pakistan supports research and development, Oil and Gas, and green hydrogen. Ministry of Energy requires audits, checks or tests; • including reports."),
    (3, "And more of it. The policy"), (4, None), (5, ""), (6, "UAE will provide USD 5 million; UAE will provide USD 5 million"), (7, "He was there; no verb. He was there; no verb. National Grid targets growth through roads, rails and ports! Will stay."),
    (None, "The ministry plans to act."), (8, "The policy supports roads. It is old and is new, and has been."), (9, "The program includes"),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = propositions.propositions(spark.createDataFrame([(*r, "clash") for r in TEXTS], "doc_id long, text string, subject string")).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.sentence, r.part, r.item)):
        out.setdefault(r.doc_id, []).append(r)
    return out


def triples(rows):
    return [(r.subject, r.predicate, r.object) for r in rows]


def test_lists_and_carried_subjects(found):
    rows = found[1]
    assert triples(rows) == [
        ("The strategy", "supports", "solar"), ("The strategy", "supports", "wind and hydrogen"), ("The strategy", "aims to", "reduce costs by 40 percent by 2030"), ("The strategy", "aims to", "with new meters"), (None, None, "It is late"),
    ]
    assert [r.source for r in rows] == ["explicit", "explicit", "explicit", "inherited", "missing"] and [r.valid for r in rows] == [True, True, True, True, False] and rows[-1].missing == "subject,predicate"
    assert (rows[2].kind, rows[2].number) == ("percentage", 40.0)


def test_protected_phrases_keep_their_spelling(found):
    assert triples(found[2]) == [
        ("Pakistan", "supports", "research and development"), ("Pakistan", "supports", "Oil and Gas"), ("Pakistan", "supports", "green hydrogen"), ("Ministry of Energy", "requires", "audits"), ("Ministry of Energy", "requires", "checks or tests"), ("Ministry of Energy", "requires", "including reports"),
    ]


def test_nulls_and_sentences_without_parts(found):
    assert 4 not in found and 5 not in found and triples(found[3]) == [(None, None, "more of it"), ("The policy", None, "The policy")] and triples(found[None]) == [("The ministry", "plans to", "act")]
    assert triples(found[9]) == [("The program", "includes", None)] and found[9][0].missing == "object"
    assert triples(found[8])[-1][2] == "It is old and is new, and has been"


def test_confidence(found):
    first, second = found[1][0], found[1][2]
    assert first.confidence == pytest.approx(round((2 + 2 + 2 + 0.5 + 0.95 + 0.95 + 2) / 11, 3)) and second.confidence == pytest.approx(round((2 + 2 + 2 + 0.9 + 1 + 0.95 + 2) / 11, 3))
    money = found[6][0]
    assert (money.kind, money.number, money.confidence) == ("currency", 5.0, pytest.approx(round((2 + 2 + 2 + 0.8 + 1 + 0.95 + 2) / 11, 3)))


def test_repeated_sentences_go_on_with_their_subject(found):
    assert [r.subject for r in found[7]][:4] == [None] * 4 and triples(found[7])[4:6] == [("National Grid", "targets", "growth through roads"), ("National Grid", "targets", "rails and ports")]


def test_no_texts(spark):
    assert propositions.propositions(spark.createDataFrame(TEXTS, "doc_id long, text string").limit(0)).count() == 0


@pytest.mark.parametrize(
    ("statement", "score", "reasons"),
    [
        ("The programme adds 30 MW and includes storage for many homes.", 100, ""), ("Country: Oman", 0, "metadata,heading,fragment"), ("Executive summary", 0, "heading,fragment"), ("Is it a market for solar power today?", 30, "question"),
        ("10 20 30 capacity values", 60, "table_row"), ("a | b | c with many words in this row of cells", 55, "table_row"), ("This is a synthetic test document of some length.", 35, "internal_test_content"), ("wind and solar,", 55, "fragment"), ("Global", 0, "heading,fragment,low_information"), ("12345", 0, "heading,fragment,low_information"),
        (None, 0, "empty_statement"), (" \t", 0, "empty_statement"),
    ],
)
def test_quality_of_facts(spark, statement, score, reasons):
    from factloom.operators import factquality

    found = factquality.judged(spark.createDataFrame([(statement,)], "s string"), "s").first()
    assert (found.score, found.reasons, found.accepted) == (score, reasons, score >= 45)


def test_lists_are_made_once_and_texts_dealt_out(spark):
    plan = propositions.propositions(spark.createDataFrame(TEXTS, "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "size(" in x]  # a filter on sizes would take every list apart again, in copies
    assert plan.count("RepartitionByExpression [doc_id") == 1 and plan.count("Window [") == 1


#: As the code before gave them.
EXPECTED = [
    (0, 0, 0, "The policy", "will Reduce", "explicit", "Oil and gas"),
    (0, 0, 1, "The policy", "will Reduce", "explicit", "green hydrogen"),
    (0, 0, 2, "The policy", "will Reduce", "explicit", "Oil and gas and research, development and innovation"),
    (0, 1, 0, "The policy", "will Reduce", "inherited", "parks or roofs"),
    (1, 0, 0, None, "shall go", "explicit", None),
    (2, 0, 0, None, "shall go", "explicit", None),
]


def test_phrases_again_and_a_predicate_of_two_words(spark):
    text = "The policy will  Reduce Oil and gas, green hydrogen, oil and Gas and research, development and innovation; parks or roofs. ; It shall go. ; It shall go."
    rows = propositions.propositions(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r.sentence, r.part, r.item, r.subject, r.predicate, r.source, r.object) for r in rows] == EXPECTED
