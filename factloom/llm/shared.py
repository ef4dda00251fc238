"""Helpers that several operators of this subpackage use: shared tables, size-checked broadcasts and word counts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space (Java and RE2 read this pattern alike).
WORD = r"[^\x20\x09-\x0D]+"
#: The characters with the Unicode property White_Space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, unless they find it by the working folder or PYTHONPATH anyway."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    if getattr(sc, "factloom_shipped", False):
        return
    sc.factloom_shipped = True
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = Path(tempfile.mkdtemp(prefix="factloom-")) / "factloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "factloom").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(archive))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or on one machine, where that is unset (tests), a folder of our own."""
    ship(spark)
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage at a committed table, so a lost executor costs at most the tasks that read it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/factloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Mark df for broadcast if it has at most max_rows (counted) rows; otherwise leave the join to Spark.

    df should be a table that is already written, so that counting it is cheap; its rows should be narrow.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def word_count(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw52(*parts: Column) -> Column:
    """A number from 0 up to 2**52 (exclusive) from the md5 of the parts, the same in every run and in any engine with md5."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
