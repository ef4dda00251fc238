"""A session of Spark, DuckDB views on the driver's tables, and the comparison of both."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in sorted(Path(SF_DIR).glob("*.parquet")):
        files = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(value):
    """A value as both engines write it: numbers to nine digits, times as text."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(value) else float(f"{float(value):.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in value.items()))
    if isinstance(value, datetime.date):
        return str(value).replace("+00:00", "")
    return value


@pytest.fixture(scope="session")
def same_rows(duck):
    """Fails unless a DataFrame and an SQL text give the same columns and the same rows, however ordered."""

    def compare(df, sql):
        columns = sorted(df.columns)
        found = sorted(repr(tuple(plain(v) for v in row)) for row in df.select(*columns).collect())
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        places = [names.index(c) for c in columns]
        expected = sorted(repr(tuple(plain(row[i]) for i in places)) for row in result.fetchall())
        assert found == expected
        return found

    return compare
