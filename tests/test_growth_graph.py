"""Augmentation and scored facts do no more than their results need, and give the same."""

from __future__ import annotations

from factloom.operators import augmentation, factquality, knowledge
from factloom.plans import discovery


def test_links_and_synchronising_plan_no_relationships(spark, sf_dir, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("a plan with relationships was made")

    monkeypatch.setattr(augmentation, "plan", refused)
    assert discovery.grf14(spark, sf_dir).count() > 0 and discovery.grf15_duplicates(spark, sf_dir).count() > 0


def test_facts_are_grouped_once_for_two_plans(spark, sf_dir, monkeypatch):
    made, plain = [], augmentation.discovered
    monkeypatch.setattr(augmentation, "discovered", lambda facts: made.append(1) or plain(facts))
    assert discovery.grf16(spark, sf_dir).count() > 0 and len(made) == 1


def test_keys_of_objects(spark):
    spelled = {"cold gizmo": "cold gizmo", "Cold  Gizmo": "cold gizmo", " a-b_c ": "a b c", "5 % of €7": "5 % of €7", "é": "", "\tx\n": "x", None: "", "": ""}
    rows = spark.createDataFrame([(k,) for k in spelled], "object string")
    assert {r.object: r.key for r in rows.withColumn("key", augmentation.key_of(rows["object"])).collect()} == spelled


def test_first_object_and_sources_of_a_key(spark):
    rows = [(3, "A b", None, 1), (2, "a  B", "date", 1), (5, "a b", None, 2), (2, "A-b", None, None), (None, "x y", None, 7), (1, "x y", None, 8), (4, "x Y", None, 8), (9, " ", None, 1)]
    found = augmentation.discovered(spark.createDataFrame(rows, "rel_id long, object string, value_type string, source long"))
    assert {(r.key, r.name, r.n_sources) for r in found.collect()} == {("a b", "A-b", 2), ("x y", "X Y", 2)}


def test_edges_with_two_sources_at_most(spark):
    rows = [
        (4, "E1", "Runs", "a  B", None, 0.5, 1), (2, "E1", "runs", "A b", None, None, 1), (3, "E1", " runs", "a b", "", 0.25, None), (5, "E1", "runs", "Nation-1", "E9", 1.0, 1), (6, "E1", "runs", "nation_1", "E9", 0.0, 2),
        (7, "E1", "runs", "nation_1", "E9", 0.5, 3), (8, "E2", "has\t it", "x\ty", None, 0.1, None), (None, "E2", "has it", "X y", None, 0.1, None), (9, None, "runs", "z", None, 1.0, 1), (10, "E3", "runs", " ", None, 1.0, 1),
    ]
    said = spark.createDataFrame(rows, "rel_id long, subject_id string, predicate string, object string, object_id string, confidence double, source long")
    exact, short = [sorted((r.asDict() for r in knowledge.edges_of(said, most_sources=m).collect()), key=str) for m in (True, False)]
    assert [{**r, "n_sources": min(2, r["n_sources"])} for r in exact] == short and [r["n_sources"] for r in exact if r["target_node"] == "E9"] == [3]


def test_scored_edges_sort_no_sources(spark):
    said = spark.createDataFrame([], "rel_id long, subject_id string, predicate string, object string, object_id string, confidence double, source long")
    asked = spark.createDataFrame([], "entity_id string, question string")
    found = knowledge.relevant_facts(knowledge.edges_of(said, most_sources=False), asked, asked.withColumnRenamed("question", "name"))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    # each fact's words are taken apart in one place, the projection of its score
    assert plan.count("array_intersect") == 1 and "count(distinct" not in plan


def test_statements_are_judged_once(spark):
    rows = spark.createDataFrame([(1, "a line")], "doc_id long, line string")
    found = factquality.rejections(factquality.judged(rows, "line"))
    # a filter below the judging would make every figure test twice
    assert found._jdf.queryExecution().optimizedPlan().toString().count("[0-9]+(?:[,.][0-9]+)?") == 1


def test_words_by_letter_are_the_same_words(spark):
    words = factquality.VERB.removeprefix(r"(?i)\b(?:").removesuffix(r")\b").replace("s?", "s").split("|")
    lines = [x for w in words for x in (w, w.upper(), f"it {w[:-1]} so", f"x{w}", f"{w}x", f"a {w}.")] + ["", "no such word", "ſhall"]
    data = spark.createDataFrame([(x,) for x in lines], "t string")
    assert data.where(data["t"].rlike(factquality.VERB) != data["t"].rlike(factquality._by_letter(factquality.VERB))).count() == 0
