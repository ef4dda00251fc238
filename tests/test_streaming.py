"""Streams give what the batch forms give."""

from __future__ import annotations

import datetime

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from factloom.streaming import counters, processing

DAY = datetime.datetime(2024, 1, 30)


def streamed(spark, tmp_path, rows, schema, transform, mode):
    """The rows that transform gives of a stream of files, one file a batch."""
    for k, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
    name = f"t{abs(hash(str(tmp_path)))}"
    run = transform(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    return spark.table(name)


def test_monthly_counts(spark, tmp_path):
    rows = [(u, DAY + datetime.timedelta(days=d)) for u, d in [(1, 0), (1, 0), (1, 3), (2, 0)]]
    found = streamed(spark, tmp_path, rows, "user_id long, ts timestamp", counters.monthly_counts, "update")
    last = found.groupBy("user_id", "month").agg(F.max("n").alias("n")).collect()
    assert sorted((r["user_id"], r["month"].month, r["n"]) for r in last) == [(1, 1, 2), (1, 2, 1), (2, 1, 1)]


def test_first_arrivals(spark, tmp_path):
    rows = [(k, t, DAY) for k, t in enumerate(["same", "same", "other", "same"])]
    found = streamed(spark, tmp_path, rows, "doc_id long, text string, ts timestamp", counters.first_arrivals, "append")
    assert sorted(r["text"] for r in found.collect()) == ["other", "same"]


def job_events():
    kinds = ["request", "request", "completed", "request", "failed", "request", "request", "completed", "completed", "request"]
    return [(10 * k + doc, doc, DAY + datetime.timedelta(minutes=k), kind) for k, kind in enumerate(kinds) for doc in (1, 2) if doc == 1 or k % 3]


def test_one_active_job_a_document(spark, tmp_path):
    rows, schema = job_events(), "event_id long, doc_id long, ts timestamp, kind string"
    active, expected = {}, {}
    for event, doc, _, kind in rows:
        expected[event] = kind if kind != "request" else "refused" if active.get(doc) else "accepted"
        active[doc] = kind == "request"
    batch = {r.event_id: r.decision for r in processing.decisions(spark.createDataFrame(rows, schema)).collect()}
    assert batch == expected and "refused" in batch.values()
    stream = {r.event_id: r.decision for r in streamed(spark, tmp_path, rows[:8], schema, processing.decided, "append").collect()}
    assert stream == {k: expected[k] for k in stream} and len(stream) == 8


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_documents_are_replaced_as_a_whole(spark):
    path, long = processing.new_store(spark), "A sentence of some words to be cut. " * 200
    assert processing.stored(spark, path).count() == 0
    first = {r.doc_id: (r.status, r.n_chunks) for r in processing.reprocess(texts(spark, [(1, long), (2, long), (None, long), (3, "short")]), path).collect()}
    assert first[3] == ("failed", 0) and first[1] == first[None] == first[2] and first[1][0] == "completed" and first[1][1] > 1
    before = {r.doc_id: r.n for r in processing.stored(spark, path).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert before == {k: first[1][1] for k in (1, 2, None)}
    again = {r.doc_id: r.status for r in processing.reprocess(texts(spark, [(1, "New words here. " * 30), (2, ""), (4, long)]), path).collect()}
    assert again == {1: "completed", 2: "failed", 4: "completed"}
    after = {r.doc_id: (r.n, r.first) for r in processing.stored(spark, path).groupBy("doc_id").agg(F.count("*").alias("n"), F.min_by(F.substring("content", 1, 3), "chunk").alias("first")).collect()}
    assert after == {1: (1, "New"), 2: (first[1][1], "A s"), None: (first[1][1], "A s"), 4: (first[1][1], "A s")}


def test_a_run_that_fails_leaves_the_store(spark):
    path, long = processing.new_store(spark), "A sentence of some words to be cut. " * 40
    processing.reprocess(texts(spark, [(1, long), (2, long)]), path)
    held = sorted(map(tuple, processing.stored(spark, path).collect()), key=repr)
    with pytest.raises(ValueError, match="twice"):
        processing.reprocess(texts(spark, [(1, "x" * 500), (1, "y" * 500)]), path)

    @F.udf("string")
    def broken(_):
        raise RuntimeError("no text")

    with pytest.raises(PythonException):
        processing.reprocess(texts(spark, [(1, "x" * 500), (2, "y")]).withColumn("text", broken("text")), path)
    assert sorted(map(tuple, processing.stored(spark, path).collect()), key=repr) == held
    assert processing.reprocess(texts(spark, [(1, long)]).limit(0), path).count() == 0
    assert sorted(map(tuple, processing.stored(spark, path).collect()), key=repr) == held
