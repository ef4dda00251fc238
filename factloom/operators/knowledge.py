"""The hybrid graph of entities and literal objects: its edges, nodes and indexes, one hop from an entity, and what speaks for an edge.

Statements(rel_id, subject_id, predicate, object, object_id, confidence, source) become edges by subject, predicate and object: an object
is an entity where object_id is known, else the literal itself (by key: lower case, single spaces). All is grouping and equi-joins; an
edge's provenance is kept as distinct sources, so an edge that a third of all statements make stays one row.

Defined cases: null subjects and empty objects make no edge; null confidences count as 0; of equal literals the first spelling
names the node; repeated statements of one source count as occurrences, not as provenance; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of a fact's score: confidence, relevance to the question, occurrences (three are enough), provenance (two are).
CONFIDENCE, RELEVANCE, OCCURRENCES, PROVENANCE = 0.45, 0.35, 0.1, 0.1


def graph_key(value: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    # most values have single spaces already
    return F.when(low.contains("  ") | low.rlike("[\t\n\x0b\f\r]"), F.regexp_replace(low, r"\s+", " ")).otherwise(low)


def edges_of(statements: DataFrame, most_sources: bool = True) -> DataFrame:
    """edge, source_node, predicate, target_node, object, is_literal, occurrences, average, greatest, n_sources of the statements; edge is the least rel_id.

    Without most_sources n_sources stops at two, which is enough for a score, and no source is sorted or kept.
    """
    literal = F.coalesce(F.trim("object_id"), F.lit("")) == ""
    target = F.when(literal, F.concat(F.lit("OBJECT::"), graph_key(F.col("object")))).otherwise(F.col("object_id"))
    rows = statements.where(F.coalesce(F.trim("subject_id"), F.lit("")) != "").where(~literal | (F.trim(F.coalesce("object", F.lit(""))) != ""))
    own = F.coalesce("confidence", F.lit(0.0))
    if not most_sources:
        # first by the object as written: all of this is numbers, so nothing is sorted
        said = rows.groupBy(F.col("subject_id").alias("source_node"), F.col("predicate").alias("said"), "object", "object_id").agg(
            F.min("rel_id").alias("rel_id"), F.count("*").alias("n"), F.sum(own).alias("total"), F.max(own).alias("most"), F.min("source").alias("low"), F.max("source").alias("high"), F.count_if(F.col("rel_id").isNull()).alias("none"),
        )
        n_sources = F.when(F.min("low").isNull(), 0).when(F.min("low") == F.max("high"), 1).otherwise(2)
        return said.groupBy("source_node", graph_key(F.col("said")).alias("predicate"), target.alias("target_node"), literal.alias("is_literal")).agg(
            F.min("rel_id").alias("edge"), F.min(F.struct(F.when(F.col("none") == 0, F.col("rel_id")), "object")).getField("object").alias("object"), F.sum("n").alias("occurrences"), (F.sum("total") / F.sum("n")).alias("average"), F.max("most").alias("greatest"), n_sources.cast("long").alias("n_sources"),
        )
    return rows.groupBy(F.col("subject_id").alias("source_node"), graph_key(F.col("predicate")).alias("predicate"), target.alias("target_node"), literal.alias("is_literal")).agg(
        F.min("rel_id").alias("edge"), F.min(F.struct("rel_id", "object")).getField("object").alias("object"), F.count("*").alias("occurrences"), F.avg(own).alias("average"), F.max(own).alias("greatest"), F.count_distinct("source").alias("n_sources"),
    )


def object_nodes(edges: DataFrame) -> DataFrame:
    """node, value, n_edges of the literal objects; the first edge names a node."""
    return edges.where("is_literal").groupBy(F.col("target_node").alias("node")).agg(F.min(F.struct("edge", "object")).getField("object").alias("value"), F.count("*").alias("n_edges"))


def snapshot(edges: DataFrame) -> DataFrame:
    """predicate, n_edges, n_literal, n_subjects, n_objects, occurrences: the predicate index with its counts."""
    return edges.groupBy("predicate").agg(F.count("*").alias("n_edges"), F.count_if("is_literal").alias("n_literal"), F.count_distinct("source_node").alias("n_subjects"), F.count_distinct("target_node").alias("n_objects"), F.sum("occurrences").alias("occurrences"))


def adjacency(edges: DataFrame) -> DataFrame:
    """node, other, edge, predicate, direction: both directions of the edges between entities."""
    own = edges.where(~F.col("is_literal"))
    out = own.select(F.col("source_node").alias("node"), F.col("target_node").alias("other"), "edge", "predicate", F.lit("outgoing").alias("direction"))
    return out.unionByName(own.select(F.col("target_node").alias("node"), F.col("source_node").alias("other"), "edge", "predicate", F.lit("incoming").alias("direction")))


def neighbours(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """node, other, name, edge, predicate, direction of entities(entity_id, name) that edges join; a neighbour that is no entity has no name."""
    return adjacency(edges).join(entities.select(F.col("entity_id").alias("other"), "name"), "other", "left").select("node", "other", "name", "edge", "predicate", "direction")


def one_hop(edges: DataFrame, entities: DataFrame, literal_only: bool = False) -> DataFrame:
    """path_id, start, end, predicate, depth, confidence: the paths of one edge from every entity. With literal_only those to objects, as deeper walks find them (objects lead nowhere)."""
    own = edges.join(entities.select(F.col("entity_id").alias("source_node")).distinct(), "source_node", "left_semi")
    own = own.where("is_literal") if literal_only else own
    return own.select(F.concat_ws("::", "source_node", F.col("edge").cast("string")).alias("path_id"), F.col("source_node").alias("start"), F.col("target_node").alias("end"), "predicate", F.lit(1).alias("depth"), F.round("average", 6).alias("confidence"))


def evidence(edges: DataFrame, statements: DataFrame) -> DataFrame:
    """start, edge, predicate, object, average, source, rel_id: every statement behind every edge."""
    literal = F.coalesce(F.trim("object_id"), F.lit("")) == ""
    target = F.when(literal, F.concat(F.lit("OBJECT::"), graph_key(F.col("object")))).otherwise(F.col("object_id"))
    rows = statements.select(F.col("subject_id").alias("source_node"), graph_key(F.col("predicate")).alias("predicate"), target.alias("target_node"), "source", "rel_id")
    return edges.join(rows, ["source_node", "predicate", "target_node"]).select(F.col("source_node").alias("start"), "edge", "predicate", "object", F.round("average", 6).alias("average"), "source", "rel_id")


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9%$€£.\- ]", " "), r"\s+"), lambda x: F.length(x) > 1))


def relevant_facts(edges: DataFrame, asked: DataFrame, names: DataFrame, most: int = 10, least: float = 0.0) -> DataFrame:
    """entity_id, rank, edge, relevance, score of the `most` (up to 100) best facts of every asked(entity_id, question), by score, then edge.

    names(entity_id, name) gives subjects their names. A question without words is met by any fact.
    """
    # the words of a question are made once for it, not for each of its facts
    asked = asked.select("entity_id", _tokens(F.col("question")).alias("words"))
    rows = edges.withColumnRenamed("source_node", "entity_id").join(asked, "entity_id").join(names.select("entity_id", "name"), "entity_id", "left")
    said = _tokens(F.concat_ws(" ", "name", "predicate", "object"))
    rows = rows.withColumn("relevance", F.when(F.size("words") == 0, 1.0).otherwise(F.size(F.array_intersect("words", said)) / F.size("words")))
    score = F.least(F.lit(1.0), F.col("average")) * CONFIDENCE + F.col("relevance") * RELEVANCE + F.least(F.lit(1.0), F.col("occurrences") / 3) * OCCURRENCES + F.least(F.lit(1.0), F.col("n_sources") / 2) * PROVENANCE
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("score"), "edge"))
    rows = rows.select("entity_id", "edge", "relevance", F.round(score, 6).alias("score")).withColumn("rank", rank).where(F.col("rank") <= max(1, min(most, 100)))
    # facts below the least score come last, so they are left out after ranks; before, each score would be made twice
    return rows.where(F.col("score") >= least).select("entity_id", "rank", "edge", F.round("relevance", 6).alias("relevance"), "score")


def formatted(names: Column, predicates: Column) -> Column:
    """A path as text, one name or predicate a line; predicates are one fewer than names."""
    steps = F.transform(names, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("    │\n "), F.coalesce(F.get(predicates, i - 1), F.lit("RELATED_TO")), F.lit("\n    │\n"), x)))
    return F.array_join(steps, "\n")
