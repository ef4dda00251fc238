"""What must not grow: how often texts are read, and how many batches short texts make. The functions are held against their plain patterns."""

from __future__ import annotations

import datetime
import itertools
import random
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.operators import chunking, numbers, tracing
from factloom.streaming import processing

TEXTS = st.lists(st.sampled_from([*"0123456789", *" .,-%$€é\n\t_(", "usd ", "EUR", " MW", "tonnes ", " 20", "19", "CA-", "Table ", "ISO-", "Plan Of Energy", "is ", "- ", "a) ", "1. ", "\r\n", "\x1c", "x"]), max_size=60).map("".join)


def batches_of(frame, monkeypatch, make):
    """The batches that make(frame) gives of 500 short texts that come in one batch."""
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, run, schema: run)
    rows = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array(["Adds 5 MW in 2030 to it.\n- a line"] * 500)], names=["doc_id", "text"])
    return list(make(frame)([rows]))


def test_a_run_reads_its_documents_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    path, long = processing.new_store(spark), "A sentence of some words to be cut. " * 40
    for rows in ([(1, long), (2, long), (3, "short")], [(1, long), (4, None)]):
        read.value = 0
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).mapInArrow(seen, "doc_id long, text string")
        jobs = {r.doc_id: r.status for r in processing.reprocess(docs, path).collect()}
        assert jobs == {k: "completed" if t == long else "failed" for k, t in rows}
        assert read.value == len(rows)


def test_blocks_of_short_texts_share_batches(spark, monkeypatch):
    found = batches_of(spark.createDataFrame([], "doc_id long, text string"), monkeypatch, chunking.context_blocks)
    assert [b.num_rows for b in found] == [500]


def test_claims_of_short_texts_share_batches(spark, monkeypatch):
    found = batches_of(spark.createDataFrame([], "doc_id long, text string"), monkeypatch, lambda df: numbers._each(df, ["doc_id"], "text", numbers.claims, "place long, raw string, value double, currency string, unit string, year long, around string"))
    assert [b.column(0).to_pylist() for b in found] == [list(range(500))]


def test_numbers_of_short_texts_share_batches(spark, monkeypatch):
    found = batches_of(spark.createDataFrame([], "doc_id long, text string"), monkeypatch, lambda df: numbers.numbers_of(df, ["doc_id"]))
    assert [b.num_rows for b in found] == [1000] and found[0].column(0).to_pylist()[:3] == [0, 0, 1]


_UNITS = "%|percent|usd|eur|gbp|million|billion|mtco2e|tco2e|mw|gw|kg|tonnes?|tons?|years?"


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_claims_are_those_of_the_plain_pattern(text):
    clean = re.sub(r"\s+", " ", text.replace("\x00", "")).strip()
    plain = re.finditer(rf"(?:([$€£]|usd|eur|gbp)\s*)?(\d+(?:,\d{{3}})*(?:\.\d+)?)\s*({_UNITS})\b", clean, re.I | re.A)
    years = lambda at: [(abs(max(0, at - 90) + y.start() - at), y.start(), int(y[0])) for y in re.finditer(r"\b(?:19|20)\d{2}\b", clean[max(0, at - 90) : at + 90], re.A)]
    expected = [(m.start(), m[0], numbers.SIGNS.get((m[1] or "").lower(), (m[1] or "").lower()), min(years(m.start()))[2] if years(m.start()) else None) for m in plain]
    assert [(at, raw, sign, year) for at, raw, _, sign, _, year, _ in numbers.claims(text)] == expected


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_numbers_are_those_of_the_plain_patterns(text):
    clean = re.sub(r"\[?CA-\d+\]?", " ", text, flags=re.I | re.A)
    clean = re.sub(r"\b(?:ISO|Article|Section|Chapter|Clause|Table|Figure|Annex|Appendix|Schedule|Rule|Regulation)-?\s*\d+(?:[.-]\d+)*\b", " ", clean, flags=re.I | re.A)
    clean = re.sub(r"\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b", lambda m: m[0].replace(",", ""), clean, flags=re.A)
    clean = re.sub(r"\s+", " ", clean).strip()
    units = r"%|percent(?:age)?s?|pct|years?|kilowatts?|megawatts?|gigawatts?|kw|mw|gw|kilograms?|kg|tons?|tonnes?|tco2e|mtco2e|usd|eur|gbp|pkr"
    expected = [(m.start(), m[0].strip()) for m in re.finditer(rf"(?<![\w-])(-?\d+(?:\.\d+)?)\s*({units})?(?![\w-])", clean, re.I | re.A)]
    signed = [(m.start(), m[0]) for m in re.finditer(r"(?<![\w-])([$€£])\s*(-?\d+(?:\.\d+)?)(?![\w-])", clean, re.A)]
    found = [(at, raw) for at, raw, *_ in numbers.numbers(text)]
    assert found == sorted([x for x in expected if not re.match(r"0{2,}(?:\s|$)", x[1])] + signed, key=lambda x: x[0])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["Plan Of Energy", "some words that go on and on", "Overview", "1. Goals", "- item one", "a) b", "Energy Is here.", "", " \t", "\xa0x", "A Much Longer Title With Eight Whole Words Here"]), max_size=12))
def test_headings_are_those_of_the_plain_rule(lines):
    def plain(line, before, after):
        words = chunking.bare(line).split()
        if not chunking.is_title(words):
            return False
        if any(p.fullmatch(after) for _, p in chunking._MARKED) and len(words) <= 6:
            return True
        return not chunking.is_sentence(chunking.bare(line)) and (not before or not after or len(words) <= 4)

    tidy = [re.sub(r"[ \t]+", " ", x.replace("\xa0", " ")).strip() for x in lines]
    assert [chunking.tidy(x) for x in lines] == tidy
    for before, line, after in zip(["", *tidy], tidy, [*tidy[1:], ""], strict=False):
        assert not line or chunking.is_heading(line, before, after) == plain(line, before, after)


def test_contradictions_equal_all_pairs_and_none_is_shuffled(spark):
    """Before, every figure of a pair of texts was shuffled by unit and year to meet the other text's."""
    fields = "answer_id long, place int, doc_id long, country string, published date, section string, content string"
    draw, words = random.Random(3), ["solar", "grids", "capacité", "Ωμέγα", "storage", "hydrogen", "reaches", "the"]
    figure = lambda: f"{draw.choice(words)} {draw.choice(words)} {draw.choice(['', 'USD ', '€'])}{draw.randint(1, 3)} {draw.choice(['MW', 'million', '%'])} {draw.choice(words)} by {draw.choice([2030, 2031])}."
    text = lambda: " ".join(figure() + " filler" * draw.randint(0, 30) for _ in range(draw.randint(0, 8)))
    day = datetime.date(2020, 1, 1)
    single = [(a, p, 10 * a + p, draw.choice(["X", "x ", None]), draw.choice([None, day]), draw.choice(["", "A"]), text() or None) for a in range(6) for p in range(7)]
    twice = [(9, p, p % 3, "X", None, "", text()) for p in range(6)]
    for rows in (single, twice):
        expected = {}
        for l, r in itertools.product(rows, rows):
            near = lambda x, y, least: len(x & y) >= max(2, least * min(len(x), len(y)))
            same = l[0] == r[0] and l[1] < r[1] and l[2] != r[2] and (l[3] or "").strip().lower() == (r[3] or "").strip().lower()
            if same and ((l[5] and l[5] == r[5]) or near(set(numbers.words_of(l[6] or "")), set(numbers.words_of(r[6] or "")), 0.3)):
                for x, y in itertools.product(numbers.claims(l[6] or ""), numbers.claims(r[6] or "")):
                    if x[4:6] == y[4:6] and x[2] != y[2] and (not x[3] or not y[3] or x[3] == y[3]) and near(set(numbers.words_of(x[6])), set(numbers.words_of(y[6])), 0.35):
                        newer = "undetermined" if l[4] == r[4] else "left" if l[4] else "right"
                        key, value = (l[0], x[4], x[3] or y[3], x[5], l[2], x[2], r[2], y[2]), (l[1], r[1], x[0], y[0], x[1], y[1], newer)
                        expected[key] = min(expected.get(key, value), value)
        frame = spark.createDataFrame(rows, fields)
        for tile in (1, 3, 2_000):
            found = numbers.conflicts(frame, tile=tile)
            assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr((*k, *v[4:])) for k, v in expected.items()) and expected
            if rows is single:
                assert not re.search("hashpartitioning[^\n]*unit", found._jdf.queryExecution().executedPlan().toString())


def test_words_of_are_keywords(spark):
    draw = random.Random(12)
    texts = ["".join(draw.choices("abÉß0٣%$.,:/- \t\n_·ΣÅ中", k=60)) + " solar-power: 12.5%grids/x9 -1,000 2nd.. the-n" for _ in range(200)] + ["", "  ", "1234 5678"]
    for text, words in spark.createDataFrame([(x,) for x in texts], "t string").select("t", numbers.keywords(F.col("t"))).collect():
        assert numbers.words_of(text) == words


def test_spans_shuffle_neither_texts_nor_a_sentence_for_each_tile_of_claims(spark):
    """Before, each sentence went with its text to a tile of 20,000 claims each, and every match brought the text and the claim back."""
    sents = spark.range(50).selectExpr("id as doc_id", "0 as paragraph", "0 as sentence", "string(id) as sentence_text", "array('a', 'b' || id) as tokens")
    made = spark.range(30_000).selectExpr("id as turn_id", "1 as claim", "array('b' || id, 'z' || id) as tokens")
    found = tracing.covering_spans(made, sents, "turn_id", "doc_id")
    meets = re.search("FlatMapCoGroupsInArrow.*", found._jdf.queryExecution().executedPlan().toString())[0]
    assert "packed" in meets and "sentence_text" not in meets and "wanted" not in meets
    assert sorted(map(tuple, found.collect())) == [(k, 1, k, 0.5, 0, 0, str(k)) for k in range(50)]


def test_an_index_finds_what_all_pairs_have():
    draw = random.Random(8)
    words = ["the"] * 60 + ["of"] * 20 + [f"w{k}" for k in range(60)]
    held = [" ".join(sorted(set(draw.choices(words, k=draw.randint(1, 12))))) for _ in range(400)] + [""]
    wanted = [" ".join(sorted(draw.choices([*words, "new"], k=draw.randint(1, 12)))) for _ in range(300)] + ["new", "the the w1"]
    index = tracing._Index(pa.array(held))
    for least in (0.1, 0.3, 0.5, 0.7, 1.0):
        expected = []
        for k, claim in enumerate(x.split(" ") for x in wanted):
            n = [sum(t in own for t in claim) for own in (set(x.split(" ")) for x in held)]
            if max(n) and max(n) / len(claim) >= least:
                expected.append((k, n.index(max(n)), max(n) / len(claim)))
        assert list(zip(*index.covered(pa.array(wanted), least), strict=True)) == expected and expected


def test_tiles_are_dealt_evenly(spark):
    keys = tracing._spread(spark, 11)
    tasks = spark.createDataFrame([(k,) for k in keys], "tile long").repartition(4, "tile").groupBy(F.spark_partition_id()).count().collect()
    assert len(set(keys)) == 11 and max(r["count"] for r in tasks) == 3


def test_claims_go_to_texts_and_texts_stay(spark, sf_dir):
    """Before, each report was cut into sentences and shuffled once for each answer that it was retrieved for."""
    from factloom.plans import catalog
    from factloom.sources.views import view

    answers, retrieved = view(spark, sf_dir, "answers"), view(spark, sf_dir, "retrieved")
    reports = view(spark, sf_dir, "reports").select("doc_id", F.col("text").alias("content"))
    whole, found = tracing.matches(answers, retrieved), tracing.matches(answers, retrieved.drop("content"), texts=reports)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, map(tuple, whole.collect()))) and found.columns == whole.columns
    plan = catalog.QUERIES["txt17_claim_support"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Programme ") == 1 and "step-" in catalog.QUERIES["txt17_claim_support"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_numbers_follow_from_how_they_are_written(text):
    found = numbers.numbers(text)
    assert [numbers.spelled_out(raw) for _, raw, *_ in found] == [tuple(rest) for _, _, *rest in found] and not any("\n" in raw or "\t" in raw for _, raw, *_ in found)


def test_support_is_found_without_a_row_for_each_number(spark, sf_dir):
    """Before, each number of the evidence was shuffled as a row for each answer, and each number of an answer in three cells."""
    from factloom.plans import catalog

    draw = random.Random(4)
    text = lambda n: " and ".join(draw.choice(["5 MW", "5.00005 MW", "5 megawatts", "$ 5", "5 usd", "2030", "1000000", "1000001", "1000002.1", "-5%", "0", "7kg"]) for _ in range(n))
    answers, texts = [(k, text(k)) for k in range(6)], [(k, text(3 * k)) for k in range(6)]
    places = [(k, p, None if p == 2 else f"CA-{p}", (k + p) % 7) for k in range(6) for p in range(4)]  # text 6 is none
    answers, texts, places = spark.createDataFrame(answers, "answer_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(places, "answer_id long, place int, citation_id string, doc_id long")
    whole = numbers.supported(answers, places.join(texts, "doc_id").withColumnRenamed("text", "content"))
    found = numbers.backed_by(numbers.packed_numbers(answers, ["answer_id"]), places, numbers.packed_numbers(texts, ["doc_id"]), "doc_id")
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, map(tuple, whole.collect()))) and found.schema.simpleString() == whole.schema.simpleString()
    plan = catalog.QUERIES["jon11_number_support"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hits" in plan and "cell" not in plan
