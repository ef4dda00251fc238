"""From the evidence streams of questions to their truth status: normalise, prune by plan, collect, find conflicts, weigh, explain.

raw(question_id, stream, ord, source_type, subject, predicate, object, polarity, negated, confidence, document_id, relationship_id, rule): stream is one
of STREAMS, whose order is that of the records; ord orders a stream. Every step is an aggregate or window by question and key, so
questions share each job, and a question with very much evidence is split by its keys.

Defined cases: a null negated is false; a null confidence is its source's default, others are brought into 0 to 1; null names are
empty in keys; equal records keep the first; a question without evidence is INSUFFICIENT_EVIDENCE; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import scoring
from factloom.operators.evidence import MULTI_VALUED

#: The streams in order, with the source each stands for; default confidences; negated predicates and what they negate.
STREAMS = [("retrieved_chunks", "DOCUMENT"), ("document_evidence", "DOCUMENT"), ("graph_evidence", "GRAPH"), ("inferred_relationships", "INFERENCE"), ("inferred_evidence", "INFERENCE"), ("ontology_evidence", "ONTOLOGY")]
DEFAULTS = {"DOCUMENT": 0.5, "GRAPH": 1.0, "INFERENCE": 0.98, "ONTOLOGY": 0.96}
NEGATED = {
    "DOES_NOT_SUPPORT": "SUPPORTS", "DOES_NOT_SUPPORTS": "SUPPORTS", "NOT_SUPPORT": "SUPPORTS", "NOT_SUPPORTS": "SUPPORTS", "OPPOSES": "SUPPORTS", "REJECTS": "SUPPORTS", "DOES_NOT_INCLUDE": "INCLUDES", "NOT_INCLUDES": "INCLUDES",
    "IS_NOT_A": "IS_A", "IS_NOT": "IS_A", "NOT_LOCATED_IN": "LOCATED_IN", "DOES_NOT_LOCATE_IN": "LOCATED_IN",
}
#: Which streams a strategy of the planner needs beside the semantic ones.
NEEDS = {
    "SEMANTIC": [], "GRAPH": ["GRAPH"], "ONTOLOGY": ["ONTOLOGY"], "REASONING": ["GRAPH", "INFERENCE", "ONTOLOGY"], "HYBRID": ["GRAPH", "INFERENCE", "ONTOLOGY"], "COMPARISON": ["GRAPH", "INFERENCE", "ONTOLOGY"],
}
_PENALTY, _LINES = 0.45, 8


def _name(value: Column) -> Column:
    return F.coalesce(F.trim(value), F.lit(""))


def normalised(raw: DataFrame) -> DataFrame:
    """question_id, seq (stream, ord), source, subject, predicate, raw_predicate, object, polarity, confidence, document_id, relationship_id, rule."""
    number = F.coalesce(*[F.when(F.col("stream") == s, F.lit(k)) for k, (s, _) in enumerate(STREAMS)])
    own = F.coalesce(*[F.when(F.col("stream") == s, F.lit(t)) for s, t in STREAMS])
    given = F.upper(_name(F.col("source_type")))
    source = F.when(given.isin(*DEFAULTS), given).otherwise(own)
    spelled = F.regexp_replace(F.upper(_name(F.col("predicate"))), r"[\s-]+", "_")
    names = F.create_map(*[F.lit(x) for pair in NEGATED.items() for x in pair])
    said = F.upper(_name(F.col("polarity")))
    polarity = F.when(said.isin("NEGATES", "AFFIRMS"), said).when(F.coalesce("negated", F.lit(False)), "NEGATES").when(F.element_at(names, F.col("raw_predicate")).isNotNull(), "NEGATES").otherwise("AFFIRMS")
    rows = raw.where(number.isNotNull()).withColumn("source", source).withColumn("raw_predicate", spelled).withColumn("seq", F.struct(number.alias("stream"), F.col("ord").alias("ord")))
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", scoring.looked_up(F.col("source"), DEFAULTS, 0.5))))
    return rows.select(
        "question_id", "seq", "source", _name(F.col("subject")).alias("subject"), F.coalesce(F.element_at(names, F.col("raw_predicate")), F.col("raw_predicate")).alias("predicate"), "raw_predicate", _name(F.col("object")).alias("object"),
        polarity.alias("polarity"), confidence.alias("confidence"), *[_name(F.col(c).cast("string")).alias(c) for c in ("document_id", "relationship_id", "rule")],
    )


def planned(records: DataFrame, plans: DataFrame) -> DataFrame:
    """The records of the streams that plans(question_id, strategy) enable; documents' always are, and all where a question has no plan."""
    needs = F.create_map(*[x for k, v in NEEDS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in ["DOCUMENT", *v]]))])
    stream = F.element_at(F.array(*[F.lit(t) for _, t in STREAMS]), F.col("seq.stream") + 1)
    joined = records.join(plans.select("question_id", F.element_at(needs, F.col("strategy")).alias("needs")), "question_id", "left")
    return joined.where(F.col("needs").isNull() | F.array_contains("needs", stream)).drop("needs")


def collected(records: DataFrame) -> DataFrame:
    """The first record of each key (source, subject, predicate, object, polarity, document, relationship, rule, without case), with its rank by falling confidence."""
    key = F.lower(F.concat_ws("::", "source", "subject", "predicate", "object", "polarity", "document_id", "relationship_id", "rule"))
    columns = [c for c in records.columns if c != "question_id"]
    one = records.groupBy("question_id", key.alias("key")).agg(F.min_by(F.struct(*columns), "seq").alias("r")).select("question_id", "r.*")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("confidence"), "seq")))


def conflicts(found: DataFrame) -> DataFrame:
    """question_id, kind, subject, predicate, object: statements both affirmed and negated, and single-valued predicates with several objects otherwise."""
    sides = found.groupBy("question_id", "subject", "predicate", "object").agg(F.count_if(F.col("polarity") == "AFFIRMS").alias("yes"), F.count_if(F.col("polarity") == "NEGATES").alias("no"))
    polar = sides.where("yes > 0 and no > 0").select("question_id", F.lit("polarity").alias("kind"), "subject", "predicate", "object")
    several = sides.where("yes > 0").where(~F.col("predicate").isin(MULTI_VALUED)).groupBy("question_id", "subject", "predicate").agg(F.count("*").alias("n")).where("n > 1")
    several = several.join(polar.select("question_id", "subject", "predicate").distinct(), ["question_id", "subject", "predicate"], "left_anti")
    return polar.unionByName(several.select("question_id", F.lit("object").alias("kind"), "subject", "predicate", F.lit("").alias("object")))


def verdicts(questions: DataFrame, found: DataFrame, clashes: DataFrame) -> DataFrame:
    """question_id, n_evidence, n_conflicts, confidence, status, summary, lines (the first eight explanations, then the conflicts) of every question."""
    w = scoring.looked_up(F.col("source"), scoring.STREAM_WEIGHT, 0.5)
    mean = found.groupBy("question_id").agg((F.sum(F.col("confidence") * w) / F.sum(w)).alias("mean"), F.count("*").alias("n"))
    said = F.format_string("%s %s %s %s.", "source", "subject", "raw_predicate", "object")
    first = found.where(F.col("rank") <= _LINES).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", said.alias("line")))).alias("first"))
    bad = clashes.groupBy("question_id").agg(F.count("*").alias("bad"), F.sort_array(F.collect_list(F.format_string("Conflict: %s %s %s.", "subject", "predicate", F.when(F.col("object") == "", "multiple objects").otherwise(F.col("object"))))).alias("against"))
    rows = questions.select("question_id").distinct().join(mean, "question_id", "left").join(first, "question_id", "left").join(bad, "question_id", "left").fillna(0, ["n", "bad", "mean"])
    final = F.col("mean") * F.when(F.col("bad") > 0, _PENALTY).otherwise(1.0)
    rows = rows.withColumn("confidence", F.round(final, 9)).withColumn("status", scoring.truth_status(F.col("confidence"), F.col("n"), F.col("bad")))
    summary = (
        F.when(F.col("n") == 0, "Insufficient evidence to support a confident statement.").when(F.col("bad") > 0, "Contradictory evidence prevents a single confident conclusion.")
        .when(F.col("confidence") >= 0.75, "Evidence consistently supports the claim.").when(F.col("confidence") >= 0.45, "Evidence partially supports the claim.").otherwise("Available evidence is weak or incomplete.")
    )
    none = F.array().cast("array<string>")
    lines = F.concat(F.coalesce(F.transform("first", lambda x: x["line"]), none), F.coalesce("against", none))
    return rows.select("question_id", F.col("n").alias("n_evidence"), F.col("bad").alias("n_conflicts"), F.round("confidence", 6).alias("confidence"), "status", summary.alias("summary"), lines.alias("lines"))


def reasoned(raw: DataFrame, plans: DataFrame) -> DataFrame:
    """verdicts() of all planned questions from their raw streams."""
    found = collected(planned(normalised(raw), plans))
    return verdicts(plans, found, conflicts(found))
