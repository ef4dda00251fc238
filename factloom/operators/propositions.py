"""Propositions of texts: who does what, clause by clause, with lists taken apart, values read and a confidence.

Clauses are rows in their order. What is carried on is a window: a subject holds for the clauses after it in its sentence, a predicate
for later clauses of the document that go on without a verb of their own. Everything else looks at one clause, as Columns.

Defined cases: a null text has no propositions; a sentence that comes twice in a row counts as one for its subject; the
earliest predicate of a clause counts, of equally early ones the first pattern; an object that is nothing but white space is
none, and such a proposition is not valid; a protected phrase is restored in its first spelling; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.text import structured_value

#: Subjects named at the start of a clause, verbs after a leading name, and patterns of predicates, in order.
SUBJECTS = ["The strategy", "The policy", "The framework", "The government", "The ministry", "The objective", "The program", "Pakistan", "UAE"]
_VERBS = "supports|targets|plans|aims|seeks|includes|requires|provides|reduces|mobilizes"
NAMED = [
    rf"(?i)^([A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*)*)\s+(?:{_VERBS})\b", rf"(?i)^((?:Government|Ministry|Department|Authority|National)\s+of\s+[A-Z][A-Za-z\s-]+?)\s+(?:{_VERBS})\b",
    rf"(?i)^([A-Z][A-Za-z]+(?:\s+of\s+[A-Z][A-Za-z]+)+)\s+(?:{_VERBS})\b",
]
PREDICATES = [
    "supports?", "targets?", r"aims?\s+to", r"plans?\s+to", r"seeks?\s+to", "establishes?", "requires?", "includes?", r"focuses?\s+on", "prioritizes?", "provides?", "reduces?", "increases?", "mobilizes?", "produces?", "covers?", "applies?",
    "operates?", "launches?", "develops?", "introduces?", r"expects?\s+to", r"will\s+[a-z]+", r"shall\s+[a-z]+", r"must\s+[a-z]+",
]
#: How a clause goes on, and verbs that make it stand alone or that a list may hold once.
CONTINUES = r"(?i)^(?:and|or|as well as|including|such as|with|through|by|toward|towards|for|in|on|at|from)\b"
STRONG = (
    r"(?i)\b(?:is|are|was|were|has|have|had|will|shall|must|aims?|targets?|plans?|supports?|establishes?|requires?|includes?|focuses?|seeks?|provides?|reduces?|increases?|mobilizes?|produces?|covers?|applies?|operates?|launches?|develops?"
    r"|introduces?|expects?|prioritizes?)\b"
)
INDEPENDENT = r"(?i)\b(?:is|are|was|were|has|have|had|will|shall|must|supports?|targets?|aims?|plans?|seeks?|requires?|includes?|provides?|reduces?|increases?|mobilizes?|develops?|establishes?)\b"
#: Phrases that are no lists.
PROTECTED = [
    "research and development", "research, development and innovation", "carbon capture and storage", "carbon capture, utilization and storage", "carbon capture, utilisation and storage", "monitoring, reporting and verification",
    "measurement, reporting and verification", "environmental, social and governance", "law and order", "supply and demand", "health and safety", "terms and conditions", "loss and damage", "energy and water", "oil and gas", "solar and wind",
    "green hydrogen", "energy storage", "net zero", "united arab emirates",
]
CONTEXT = r"(?i)\b(?:through|via|using|with|by|from|under|within|across|toward|towards|for|into|of)\b\s*$"


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\x00"), F.lit("")), r"\s+", " "))


def clauses(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, sentence, part (both from 0), clause, new (whether its sentence begins, and says something else than the one before) of docs(key, text): sentences, cut at semicolons and bullets."""
    sentences = F.filter(F.split(_spaced(F.col("text")), r"(?<=[.!?])\s+"), lambda x: x != "")
    parts = F.filter(F.transform(F.split("x", "[;•]"), lambda x: F.trim(x)), lambda x: x != "")
    rows = docs.select(key, sentences.alias("all")).select(key, F.filter(F.transform("all", lambda x, k: F.struct(k.alias("sentence"), x.alias("whole"))), lambda x: x["whole"].rlike("[^ ;•]")).alias("told"))
    # outer: else Spark would make every list a second time, to see whether it is empty
    before = lambda k: F.when(k > 0, F.get("told", k - 1)["whole"])
    rows = rows.select(key, F.explode_outer(F.transform("told", lambda x, k: F.struct(x["sentence"].alias("sentence"), x["whole"].alias("whole"), (~F.equal_null(before(k), x["whole"])).alias("new")))).alias("s")).where(F.col("s").isNotNull())
    rows = rows.select(key, "s.sentence", F.col("s.whole").alias("x"), "s.new").select(key, "sentence", "new", F.posexplode_outer(parts).alias("part", "clause"))
    return rows.select(key, "sentence", "part", "clause", (F.col("new") & (F.col("part") == 0)).alias("new"))


def _found(clause: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.trim(F.regexp_extract(clause, pattern, group)), F.lit(""))


def subject(clause: Column) -> Column:
    """The subject that a clause names at its start, or null."""
    return F.coalesce(F.nullif(F.regexp_extract(clause, f"(?i)^(?:{'|'.join(SUBJECTS)})", 0), F.lit("")), *[_found(clause, p, 1) for p in NAMED])


#: The earliest predicate of a clause; of equally early ones the first, as alternatives are tried in order.
_PREDICATE = rf"\b(?:{'|'.join(PREDICATES)})\b"


def predicate(clause: Column) -> Column:
    """The earliest predicate of a clause, or null."""
    return F.nullif(F.regexp_extract(clause, rf"(?i){_PREDICATE}", 0), F.lit(""))


def cleaned(item: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(item), r"(?i)^(?:and|or|as well as)\s+", ""), r"[.;:!?]+$", ""))


def _marked(value: Column) -> Column:
    """A value with marks for its protected phrases. None of them begins with a word that another one ends with, so their order is free."""
    safe = value
    for k, phrase in enumerate(PROTECTED):
        safe = F.regexp_replace(safe, rf"(?i)\b{phrase}\b", f"__P{k}__")
    return F.when(value.rlike(rf"(?i)\b(?:{'|'.join(PROTECTED)})\b"), safe).otherwise(value)


def _unmarked(item: Column, value: Column) -> Column:
    own = item
    for k, phrase in enumerate(PROTECTED):
        own = F.replace(own, F.lit(f"__P{k}__"), F.regexp_extract(value, rf"(?i)\b{phrase}\b", 0))
    return F.when(item.contains("__P"), own).otherwise(item)


def listed(rows: DataFrame, column: str) -> DataFrame:
    """rows with items (of an object that is a list, else an array of the object alone), prefix and expanded; each is made once a row."""
    value, items = F.col(column), F.col("l_items")
    signal = value.contains(",") & value.rlike(r"(?i)\s(?:and|or)\s+")
    single = (F.regexp_count(value, F.lit(INDEPENDENT)) <= 1) & ~value.rlike(r"[.!?]\s+[A-Z]")
    # few objects are lists; only these are taken apart
    rows = rows.withColumn("l_signal", signal & single).withColumn("l_safe", F.when(F.col("l_signal"), F.regexp_replace(_marked(value), r"(?i),\s*(?:and|or)\s+", ",")))
    bare = F.filter(F.transform(F.split("l_safe", ","), lambda x: cleaned(x)), lambda x: x != "")
    kept = F.filter(F.transform(bare, lambda x: cleaned(_unmarked(x, value))), lambda x: (F.length(x) >= 2) & ~x.rlike(r"[.!?]\s+[A-Z]"))
    rows = rows.withColumn("l_items", F.when(F.col("l_signal"), kept)).withColumn("expanded", F.col("l_signal") & (F.size("l_items") >= 2))
    rows = rows.withColumn("l_at", F.when(F.col("expanded"), F.instr(F.lower(value), F.lower(F.element_at(items, 1)))).otherwise(0))
    rows = rows.withColumn("l_before", F.when(F.col("l_at") > 1, F.trim(F.substring(value, F.lit(1), F.col("l_at") - 1))))
    rows = rows.withColumn("prefix", F.when(F.col("l_before").rlike(CONTEXT), F.col("l_before")).otherwise(""))
    return rows.withColumn("items", F.when(F.col("expanded"), items).otherwise(F.array(cleaned(value)))).drop("l_signal", "l_safe", "l_items", "l_at", "l_before")


def confidence(who: Column, what: Column, value: Column, source: Column, expanded: Column, kept_context: Column, structured: Column) -> Column:
    """Weighted mean of how sure each part of a proposition is, to three digits."""
    size = lambda c, more: F.when(F.coalesce(c, F.lit("")) == "", 0.0).when(F.length(c) > more, 1.0).otherwise(0.7)
    one = lambda c, v: F.when(c, v).otherwise(0.0)
    kind = structured["kind"]
    read = F.when(structured.isNull(), 0.5).otherwise(0.5 + one(structured["number"].isNotNull(), 0.2) + one(kind.isin("percentage", "measurement"), 0.1) + one(kind == "currency", 0.1) + one(structured["year"].isNotNull() & structured["last_year"].isNull(), 0.1))
    taken = F.when(source == "missing", 0.5).when(source == "inherited", 0.95).otherwise(1.0)
    parts = [(size(who, 2), 2), (F.when(what.isNull(), 0.0).otherwise(1.0), 2), (size(value, 3), 2), (F.least(read, F.lit(1.0)), 1), (F.when(expanded, 0.95).otherwise(1.0), 1), (F.when(kept_context, 1.0).otherwise(0.95), 1), (taken, 2)]
    return F.round(sum((c * w for c, w in parts[1:]), parts[0][0] * parts[0][1]) / sum(w for _, w in parts), 3)


def propositions(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, sentence, part, item, subject, predicate, source (explicit, inherited, missing), object, kind, number, confidence, valid, missing (parts that lack, joined) of docs(key, text)."""
    # small rows cost much work, so they are dealt out before it, by the key of the windows
    docs = docs.select(key, "text").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    upto = Window.partitionBy(key).orderBy("sentence", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = clauses(docs, key).withColumn("named", subject(F.col("clause"))).withColumn("said", predicate(F.col("clause")))
    # a sentence repeated right after itself goes on with its subject; any other begins without one
    held = F.last(F.when(F.col("new") | F.col("named").isNotNull(), F.struct("named")), ignorenulls=True).over(upto)
    rows = rows.withColumn("subject", held["named"]).withColumn("before", F.last("said", ignorenulls=True).over(upto))
    goes_on = F.col("clause").rlike(CONTINUES) | ~F.col("clause").rlike(STRONG)
    rows = rows.withColumn("source", F.when(F.col("said").isNotNull(), "explicit").when(F.col("before").isNotNull() & goes_on, "inherited").otherwise("missing"))
    rows = rows.withColumn("predicate", F.when(F.col("source") != "missing", F.coalesce("said", "before")))
    # a clause that inherits its predicate has none itself, so nothing goes from it
    rows = listed(rows.withColumn("whole_object", F.trim(F.regexp_replace("clause", rf"(?is)^.*?{_PREDICATE}", ""))), "whole_object")
    rows = rows.select(key, "sentence", "part", "subject", "predicate", "source", "prefix", "expanded", F.posexplode_outer("items").alias("item", "thing"))
    rows = rows.withColumn("object", F.nullif(F.trim(F.concat_ws(" ", F.nullif("prefix", F.lit("")), "thing")), F.lit(""))).withColumn("value", structured_value(F.col("object")))
    lacking = F.array_compact(F.array(F.when(F.col("subject").isNull(), "subject"), F.when(F.col("predicate").isNull(), "predicate"), F.when(F.col("object").isNull(), "object")))
    sure = confidence(F.col("subject"), F.col("predicate"), F.col("object"), F.col("source"), F.col("expanded"), F.col("prefix") != "", F.col("value"))
    return rows.select(key, "sentence", "part", "item", "subject", "predicate", "source", "object", F.col("value.kind").alias("kind"), F.col("value.number").alias("number"), sure.alias("confidence"), (F.size(lacking) == 0).alias("valid"), F.array_join(lacking, ",").alias("missing"))
