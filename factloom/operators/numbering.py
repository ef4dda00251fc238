"""Gapless numbers in a given order over a whole table, dealt out by ranges of that order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.graph import written


def numbered(df: DataFrame, order: list[str | Column], name: str, first: int = 1) -> DataFrame:
    """df with a column of numbers from `first` in the given order, which should tell all rows apart.

    Rows are dealt into ranges of the order and written, so that a lost task finds the same ranges again; each range counts
    its rows, and adds how many rows the ranges before it have. Only these counts pass through one task.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("range_of", F.spark_partition_id()))
    counts = ranged.groupBy("range_of").agg(F.count("*").alias("rows_of"))  # one row a range
    counts = counts.withColumn("before", F.sum("rows_of").over(Window.orderBy("range_of")) - F.col("rows_of")).drop("rows_of")
    own = F.row_number().over(Window.partitionBy("range_of").orderBy(*order))
    return ranged.withColumn(name, own).join(F.broadcast(counts), "range_of").withColumn(name, (F.col(name) + F.col("before") + (first - 1)).cast("long")).drop("range_of", "before")
