"""Knowledge-graph operators over edges(subject, predicate, object, confidence)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which the driver and all executors see."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="factloom-")  # one machine: a folder of our own
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder; cuts the lineage of loops."""
    path = f"{shared_root(df.sparkSession)}/factloom/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def undirected(edges: DataFrame) -> DataFrame:
    a = edges.select(F.col("subject").alias("node"), F.col("object").alias("other"), "predicate", F.lit("outgoing").alias("direction"))
    return a.union(edges.select("object", "subject", "predicate", F.lit("incoming")))


def reached(edges: DataFrame, start: str, depth: int = 2) -> DataFrame:
    """node, depth: nodes within `depth` undirected steps of start (without it), at their least depth.

    Each level joins only the frontier and drops what was visited; levels are written tables.
    """
    pairs = written(undirected(edges).select("node", "other").distinct())
    visited = written(edges.sparkSession.createDataFrame([(start, 0)], "node string, depth int"))
    frontier = visited
    for d in range(1, depth + 1):
        step = pairs.join(frontier.select("node"), "node", "left_semi").select(F.col("other").alias("node")).distinct()
        frontier = written(step.join(visited, "node", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.limit(1).count() == 0:
            break
        visited = visited.union(frontier)
    return visited.where("depth > 0")


def simple_paths(edges: DataFrame, start: str, target: str, depth: int = 4) -> DataFrame:
    """path, confidence: directed simple paths from start to target of at most `depth` edges; none goes on through the target."""
    links = edges.select("subject", "object", "confidence")
    state = links.where(F.col("subject") == start).select(F.array("subject", "object").alias("path"), F.col("object").alias("end"), "confidence").where("path[0] <> end")
    done = state.where(F.col("end") == target)
    for _ in range(depth - 1):
        state = state.where(F.col("end") != target)
        on = state.join(links.withColumnRenamed("confidence", "c"), F.col("end") == F.col("subject")).where(~F.array_contains("path", F.col("object")))
        state = on.select(F.concat("path", F.array("object")).alias("path"), F.col("object").alias("end"), (F.col("confidence") * F.col("c")).alias("confidence"))
        done = done.union(state.where(F.col("end") == target))
    return done.select("path", "confidence")


def composed(edges: DataFrame, predicate: str = "IS_A") -> DataFrame:
    """subject, object: one composition step of a transitive predicate, without self-links and known edges."""
    a = edges.where(F.col("predicate") == predicate).select("subject", F.col("object").alias("mid"))
    b = edges.where(F.col("predicate") == predicate).select(F.col("subject").alias("mid"), "object")
    known = edges.where(F.col("predicate") == predicate).select("subject", "object")
    return a.join(b, "mid").where(F.col("subject") != F.col("object")).select("subject", "object").distinct().join(known, ["subject", "object"], "left_anti")
