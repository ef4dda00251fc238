"""Processing of documents: one active job a document, and a chunk store whose documents are replaced as a whole.

Jobs are a state machine by document: a request is accepted if no job is active, else refused; completed and failed end the
active job. decisions() gives this for a table, decided() for a stream, with one boolean of state a document.

The store is a table in buckets of the document's key. New chunks are computed and written beside it first; only then are the
buckets of the documents that succeeded written anew, from their other documents' old rows and the new ones. Whatever fails before
leaves the store as it was, and so does a document that gives no chunks: its job fails and its old chunks stay.

Defined cases: a null document is one of its own; events at one time go by number; repeated documents in one run give an error;
an empty run changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.operators import chunking
from factloom.operators.graph import shared_root, written

BUCKETS = 32
CHUNKS = "doc_id long, chunk long, content string, section string, page_start long, page_end long, n_tokens long, n_chars long"
DECISIONS = "event_id long, doc_id long, decision string"


def decisions(events: DataFrame) -> DataFrame:
    """event_id, doc_id, decision of events(event_id, doc_id, ts, kind: request, completed or failed): requests become accepted or refused."""
    order = ["ts", "event_id"]
    ended = F.count_if(F.col("kind") != "request").over(Window.partitionBy("doc_id").orderBy(*order))
    # of the requests between two ends the first finds no active job
    first = F.row_number().over(Window.partitionBy("doc_id", "ended", "kind").orderBy(*order)) == 1
    rows = events.select("event_id", "doc_id", "ts", "kind").withColumn("ended", ended)
    return rows.select("event_id", "doc_id", F.when(F.col("kind") != "request", F.col("kind")).when(first, "accepted").otherwise("refused").alias("decision"))


def _decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    active = bool(state.get[0]) if state.exists else False
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    out = []
    for event, kind in zip(rows["event_id"].tolist(), rows["kind"].tolist(), strict=True):
        if kind != "request":
            active, decision = False, kind
        else:
            active, decision = True, "refused" if active else "accepted"
        out.append((event, key[0], decision))
    state.update((active,))
    yield pd.DataFrame(out, columns=["event_id", "doc_id", "decision"])


def decided(events: DataFrame) -> DataFrame:
    """The same of a stream of events that come in order; the state is whether a document's job is active."""
    return events.groupBy("doc_id").applyInPandasWithState(_decide, DECISIONS, "active boolean", "append", GroupStateTimeout.NoTimeout)


def new_store(spark: SparkSession) -> str:
    """The place of a new chunk store in the shared folder."""
    return f"{shared_root(spark)}/factloom/chunks-{uuid.uuid4().hex}"


def _bucket(key: str = "doc_id"):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of a store."""
    names = [f.split(" ")[0] for f in CHUNKS.split(", ")]
    return spark.read.parquet(path).select(*names) if _exists(spark, path) else spark.createDataFrame([], CHUNKS)


def reprocess(docs: DataFrame, path: str, sizes: chunking.Sizes = chunking.Sizes()) -> DataFrame:
    """Cut docs(doc_id, text) into chunks and replace those documents' rows of the store; gives doc_id, status, n_chunks of every job."""
    spark = docs.sparkSession
    # docs are read once: a document without chunks is a row of nulls here, and every document has one row that is null or chunk 0
    made = written(chunking.chunked(docs, sizes, keep=True))
    counts = written(made.groupBy("doc_id").agg(F.count("chunk").alias("n_chunks"), F.count_if(F.coalesce("chunk", F.lit(0)) == 0).alias("times")))
    again = counts.where("times > 1").limit(1).collect()
    if again:
        raise ValueError(f"document {again[0].doc_id} comes twice in one run")
    jobs = counts.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.when(F.col("n_chunks") > 0, "completed").otherwise("failed").alias("status"), "n_chunks")
    done = counts.where("n_chunks > 0").select(F.col("doc_id").alias("done"))
    if done.isEmpty():
        return jobs
    new = made.where("chunk is not null").withColumn("bucket", _bucket())
    if _exists(spark, path):
        held = spark.read.parquet(path).withColumn("bucket", F.col("bucket").cast("int"))
        touched = [r.bucket for r in done.select(_bucket("done").alias("bucket")).distinct().collect()]  # at most BUCKETS numbers
        old = held.where(F.col("bucket").isin(touched)).join(done, F.col("doc_id").eqNullSafe(F.col("done")), "left_anti")
        new = new.unionByName(written(old.select(*new.columns)))  # what is to be written no longer reads the store
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return jobs
