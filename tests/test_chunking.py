"""Heading stack and chunk packing: hand-made texts, SQL at other sizes, and what must hold for any text."""

from __future__ import annotations

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.operators import chunking
from factloom.plans import documents
from factloom.sources.views import view, with_views

SMALL = chunking.Sizes(500, 600, 60, 80)


def test_headings_above_blocks():
    text = "National Plan\n\nOverview\nThe plan is long and covers much.\n1. Energy\n- solar parks\n- wind\nWind Power\nA sentence about it is here.\n2. Finance\n(a note)\nb) bonds\n\nDeep\nGreen Bonds\n\n* last"
    found = [(n, kind, content, tuple(path), mark) for n, kind, content, path, _, mark in chunking.blocks(text)]
    assert found == [
        (4, "paragraph", "The plan is long and covers much.", ("National Plan", "Overview"), None),
        (6, "listItem", "solar parks", ("National Plan", "Energy"), "-"),
        (7, "listItem", "wind", ("National Plan", "Energy"), "-"),
        (9, "paragraph", "A sentence about it is here.", ("National Plan", "Energy", "Wind Power"), None),
        (11, "paragraph", "(a note)", ("National Plan", "Finance"), None),
        (12, "listItem", "bonds", ("National Plan", "Finance"), "b"),
        (17, "listItem", "last", ("National Plan", "Finance", "Green Bonds"), "*"),
    ]


def test_a_numbered_heading_first_is_the_title():
    assert [b[3] for b in chunking.blocks("1. Energy\nsome text here, long enough to be none\n2. Finance\nmore text of the same kind")] == [["Energy"], ["Energy", "Finance"]]


def test_pages_that_are_too_short_join():
    text = "lead\n-- 1 of 3 --\n" + "a" * 400 + "\n-- 2 of 3 --\nshort\n-- 3 of 3 --\nend"
    assert [(f, last, len(x)) for f, last, x in chunking.pages(text, 300)] == [(1, 3, len("lead\n\n") + 400 + len("\n\nshort\n\nend"))]
    assert chunking.pages("", 300) == [] and chunking.pages("x", 300) == [(None, None, "x")]


def test_long_paragraphs_fall_into_sentences_and_cuts():
    assert list(chunking.pieces("One two. Three four! " * 3, 25)) == ["One two. Three four!", "One two. Three four!", "One two. Three four!"]
    assert list(chunking.pieces("x" * 55, 25)) == ["x" * 25, "x" * 25, "x" * 5]
    assert list(chunking.pieces("?" * 30, 25)) == ["?" * 25, "?" * 5]


def test_overlap_begins_after_a_sentence():
    assert chunking.tail("First one. Second one. Third", 20) == "Second one. Third" and chunking.tail("no end here", 4) == "here" and chunking.tail("abc", 0) == ""


def test_sizes_that_cannot_be_met():
    with pytest.raises(ValueError, match="sizes"):
        chunking.Sizes(overlap=4000)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["Plan Of Energy", "some words that go on and on.", "\n", "-- 3 of 9 --", "UPPER CASE", "x" * 70, "no end mark", "What now? Yes!", "1. Goals", ""]), max_size=80).map("\n".join))
def test_what_holds_for_every_text(text):
    found = list(chunking.chunks(text, SMALL))
    assert all(c == c.strip() and c for c, *_ in found)
    # besides overlap (80), section (up to 500) and what was held below the least size, a chunk never passes the greatest size
    assert all(len(c) <= 600 + 80 + 60 + 500 for c, *_ in found)
    joined = "".join("".join(c.split()) for c, *_ in found)
    long = [p for g in chunking.pages(text, 60) if len(g[2]) >= 60 for p in g[2].split("\n\n") if p.strip() and len(p) <= 600]
    assert all("".join(p.split()) in joined for p in long)


def test_long_texts_take_one_pass(spark):
    text = "Many words in a line. " * 50_000 + "\n\n" + ("a line of words without end\n" * 20_000)
    begin = time.time()
    assert sum(len(c) for c, *_ in chunking.chunks(text, chunking.Sizes())) > 1_000_000
    assert sum(1 for _ in chunking.blocks(text)) == 20_001
    assert time.time() - begin < 20
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (None, "A line that is a text. " * 20), (1, None)], "doc_id long, text string")
    assert {r.doc_id for r in chunking.chunked(rows).collect()} == {1, None}
    assert {r.doc_id for r in chunking.context_blocks(rows).collect()} == {1, None}
    assert chunking.chunked(rows.limit(0)).count() == 0


def test_chunks_at_other_sizes_are_those_of_sql(spark, sf_dir, same_rows):
    sizes = chunking.Sizes(500, 1500, 60, 80)  # no paragraph of a report is longer, and the SQL cuts none
    found = same_rows(chunking.chunked(view(spark, sf_dir, "reports"), sizes), with_views(documents.chunk_sql(sizes)))
    assert len(found) > 500
