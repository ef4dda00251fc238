"""Values, topics, strategies and broken signs on odd input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.operators import evidence, text


@pytest.mark.parametrize(
    ("given", "kind", "number", "unit", "amount", "year", "last"),
    [
        ("USD 2,500.5 million for grids by 2030", "currency", 2500.5, "USD", 2500.5e6, 2030, None), ("eur 3 billion", "currency", 3.0, "EUR", 3e9, None, None), ("USD . million", None, None, None, None, None, None),
        ("1.2.3 GW", "measurement", 2.3, "GW", None, None, None), ("5 GWh stored", "measurement", 5.0, "GWh", None, None, None), ("12 mwh", "measurement", 12.0, "MWh", None, None, None), ("-4.5 percent, in 2019", "percentage", -4.5, "%", None, 2019, None),
        ("45%", "percentage", 45.0, "%", None, None, None), ("45%x", None, None, None, None, None, None), ("from 2020 to 2035", "year_range", None, None, None, 2020, 2035), ("plan of 2027", "year", None, None, None, 2027, None),
        ("2020 and 2021", None, None, None, None, None, None), ("", None, None, None, None, None, None), (None, None, None, None, None, None, None), ("USD ,,, and 7 tCO2", "measurement", 7.0, "tCO2", None, None, None),
        ("PKR 10 by 2030, 40% of it", "currency", 10.0, "PKR", 10.0, 2030, None),
    ],
)
def test_values(spark, given, kind, number, unit, amount, year, last):
    v = spark.createDataFrame([(given,)], "t string").select(text.structured_value(F.col("t")).alias("v")).first().v
    assert (v and (v.kind, v.number, v.unit, v.amount, v.year, v.last_year)) == (kind and (kind, number, unit, amount, year, last))


@pytest.mark.parametrize(("question", "strategy"), [("How do TVs work?", "GRAPH"), ("Solar vs wind", "COMPARISON"), ("solar vs. wind", "COMPARISON"), ("Is it a market?", "REASONING"), ("What is mrv", "ONTOLOGY"), ("When?", "SEMANTIC"), ("Tell me", "HYBRID"), ("", "HYBRID")])
def test_strategies(spark, question, strategy):
    assert spark.createDataFrame([(question,)], "q string").select(text.strategy(F.col("q"))).first()[0] == strategy


@pytest.mark.parametrize(("given", "topic"), [("Electric vehicles", "transport"), ("Industrial parks", "industry"), ("5 million", "general"), ("Solar finance", "solar_capacity"), ("a registry of MRV", "carbon_market"), ("Emissions reduction", "net_zero"), (None, "general")])
def test_topics(spark, given, topic):
    assert spark.createDataFrame([(given,)], "t string").select(text.topic(F.col("t"))).first()[0] == topic


def test_broken_signs(spark):
    df = spark.createDataFrame([("It â€™s â€œgoodâ€\x9d Â· âœ“",), (None,), ("Â·",)], "t string")
    assert [r[0] for r in df.select(text.mended(F.col("t"))).collect()] == ["It 's \"good\" · ✓", None, "·"]
    assert {r.pattern: r.n for r in text.bad_runs(df, "t").collect()}["Â·"] == 2


def test_a_claim_that_says_nothing_of_negation_affirms(spark):
    claims = spark.createDataFrame([("s", "p", "o", None), ("s", "p", "o", True), ("s", "p", "x", None)], "subject string, predicate string, object string, negated boolean")
    assert [(r.object, r.affirmed, r.negated) for r in evidence.polarity_conflicts(claims).collect()] == [("o", 1, 1)]
