"""Facts of entities by topic, and what one entity has evidence for where another has none.

Every sentence of 15 characters or more is a fact of its document's entity. Facts that say the same (by a fingerprint without
articles, case, marks and spellings of amounts) are one: the stronger is kept, then the longer, then the first, with the
sources of all. The matrix has a cell for every entity and topic, also where there is no fact.

Defined cases: null texts have no facts; a document without entity has none; null scores count as 0; ties end in the order of documents
and sentences; a topic outside TOPIC_NAMES keeps its name; empty tables give no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import text as texts
from factloom.operators.graph import written

#: Other names of topics, scales of amounts, and the pattern of an amount of money (with the space after it).
TOPIC_NAMES = {
    "renewables": "renewable_energy", "renewable": "renewable_energy", "renewable_power": "renewable_energy", "clean_energy": "renewable_energy", "green_energy": "renewable_energy", "renewable_targets": "renewable_target",
    "electricity_target": "renewable_target", "clean_energy_target": "renewable_target", "green_hydrogen": "hydrogen", "clean_hydrogen": "hydrogen", "hydrogen_strategy": "hydrogen", "carbon_credits": "carbon_market",
    "carbon_credit": "carbon_market", "emissions_trading": "carbon_market", "carbon_trading": "carbon_market", "ets": "carbon_market", "climate_finance": "investment", "green_finance": "investment", "clean_energy_investment": "investment",
    "electric_vehicles": "transport", "electric_mobility": "transport", "clean_transport": "transport", "public_transport": "transport", "pv": "solar_capacity", "solar": "solar_capacity", "solar_power": "solar_capacity",
    "photovoltaic": "solar_capacity", "wind": "wind_capacity", "wind_power": "wind_capacity", "netzero": "net_zero", "net_zero_target": "net_zero", "carbon_neutrality": "net_zero", "battery": "energy_storage", "batteries": "energy_storage",
    "battery_storage": "energy_storage", "storage": "energy_storage", "measurement_reporting_verification": "mrv", "monitoring_reporting_verification": "mrv", "verification_system": "mrv", "carbon_registry": "registry", "credit_registry": "registry",
}
SCALES = {"thousand": 1e3, "k": 1e3, "million": 1e6, "mn": 1e6, "m": 1e6, "billion": 1e9, "bn": 1e9, "b": 1e9, "trillion": 1e12, "tn": 1e12, "t": 1e12}
SIGNS = {"$": "USD", "€": "EUR", "£": "GBP"}
_AMOUNT = re.compile(r"(?:\b(USD|AED|PKR|EUR|GBP)\b|([$€£]))?\s*(\d+(?:,\d{3})*(?:\.\d+)?)\s*(thousand|million|billion|trillion|k|mn|bn|tn|m|b|t)?\s*(?:\b(USD|AED|PKR|EUR|GBP)\b)?", re.I | re.A)
_NUMBERS = [("percentage", r"\b(\d+(?:\.\d+)?)%"), ("currency", r"\b(?:USD|AED|PKR|EUR|GBP)\s+\d+(?:\.\d+)?"), ("capacity", r"(?i)\b\d+(?:\.\d+)?\s*(?:MW|GW|TW)\b"), ("emissions", r"(?i)\b\d+(?:\.\d+)?\s*(?:tCO2e|MtCO2e|GtCO2e)\b"), ("year", r"\b(?:19|20)\d{2}\b")]


def whole(number: float) -> str:
    return str(int(number)) if number.is_integer() and abs(number) < 1e21 else repr(number)


def with_amounts(statement: str) -> str:
    """A statement whose amounts of money are a currency and a plain number, and whose percentages have a sign."""

    def plain(m: re.Match) -> str:
        currency = (m[1] or m[5] or SIGNS.get(m[2] or "", "")).upper() if m[1] or m[5] or m[2] else ""
        if not currency:
            return m[0]
        return f"{m[1] or m[5] or currency} {whole(float(m[3].replace(',', '')) * SCALES.get((m[4] or '').lower(), 1.0))}"

    signed = re.sub(r"\s+%", "%", re.sub(r"\b(\d+(?:\.\d+)?)\s*(?:percent|per\s+cent)\b", r"\1%", statement, flags=re.I | re.A))
    return re.sub(r"\s+", " ", _AMOUNT.sub(plain, signed)).strip()


def _normalised(column: Column) -> Column:
    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else with_amounts(x) for x in values.to_pylist()], pa.string())

    return run(column)


def comparable(value: Column) -> Column:
    low = F.regexp_replace(F.lower(value), "[“”‘’\"'`]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"[()\[\]{},:;!?]", " "), "[–—]", "-"), r"\s+", " "))


def topic_name(topic: Column) -> Column:
    key = F.regexp_replace(comparable(F.coalesce(topic, F.lit("general"))), r"[-\s]+", "_")
    names = F.create_map(*[F.lit(x) for pair in TOPIC_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(names, key), F.nullif(key, F.lit("")), F.lit("general"))


def fingerprint(statement: Column) -> Column:
    out = comparable(statement)
    for pattern, other in ((r"\b(?:the|a|an)\b", ""), (r"\bshall\b", "will"), (r"\b(?:aims?|plans?)\s+to\b", ""), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, other)
    return F.trim(out)


def facts(evidence: DataFrame) -> DataFrame:
    """entity, topic, statement, evidence_score, semantic_score, doc_id, nth of every sentence of evidence(entity, content, evidence_score, semantic_score, doc_id)."""
    parts = F.split(F.trim(F.replace(F.coalesce("content", F.lit("")), F.lit("\x00"), F.lit(""))), r"(?<=[.!?])\s+|\n+")
    lines = F.transform(parts, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s*[-•]\s*", ""), r"\s+", " ")))
    rows = evidence.select(F.trim("entity").alias("entity"), "evidence_score", "semantic_score", "doc_id", F.posexplode(lines).alias("nth", "line")).where((F.length("line") >= 15) & (F.col("entity") != ""))
    return rows.select("entity", texts.topic(F.col("line")).alias("topic"), F.col("line").alias("statement"), F.coalesce("evidence_score", F.lit(0.0)).alias("evidence_score"), F.coalesce("semantic_score", F.lit(0.0)).alias("semantic_score"), "doc_id", "nth")


def merged(found: DataFrame) -> DataFrame:
    """entity, topic, fingerprint, statement, strength, n_merged, documents, first (place of the first) of facts that say the same."""
    # facts in the same words are one before these are normalised, which takes most of the time
    order = F.struct("evidence_score", (-F.col("doc_id")).alias("d"), (-F.col("nth")).alias("n"))
    same = found.groupBy("entity", "topic", "statement").agg(
        F.max_by(F.struct("evidence_score", "semantic_score", "doc_id", "nth"), order).alias("b"), F.count("*").alias("n"), F.collect_set("doc_id").alias("docs"), F.min(F.struct("doc_id", "nth")).alias("place")
    )
    rows = same.withColumn("statement", _normalised(F.col("statement"))).where(F.col("statement") != "").withColumn("topic", topic_name(F.col("topic")))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("statement")))
    best = F.struct("b.evidence_score", F.length("statement").alias("size"), (-F.col("b.doc_id")).alias("d"), (-F.col("b.nth")).alias("n"))
    kept = F.max_by(F.struct("statement", "b.evidence_score", "b.semantic_score"), best).alias("kept")
    documents = F.sort_array(F.array_distinct(F.flatten(F.collect_list("docs"))))
    out = rows.groupBy("entity", "topic", "fingerprint").agg(kept, F.sum("n").alias("n_merged"), documents.alias("documents"), F.min("place").alias("first"))
    strength = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("kept.evidence_score") * 0.6 + F.col("kept.semantic_score") * 0.4))
    return out.select("entity", "topic", "fingerprint", F.col("kept.statement").alias("statement"), strength.alias("strength"), "n_merged", "documents", "first")


def numbers(statement: Column) -> Column:
    """The distinct figures of a statement: percentages, amounts, capacities, emissions, years."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(statement, F.lit(p), F.lit(0)) for _, p in _NUMBERS])))


def matrix(one: DataFrame, entities: list[str] | None = None) -> DataFrame:
    """entity, topic, has_evidence, n_facts, strength (percent of the strongest), statement (the strongest), numbers, n_documents of merged facts.

    Every entity (those asked for, or all that have facts) has a row for every topic that one of them has facts of.
    """
    if entities is not None:
        one = one.where(F.col("entity").isin(entities))
    # read four times below, so the facts are made once
    one = written(one)
    strongest = F.max_by(F.struct("statement", "strength"), F.struct("strength", (-F.col("first.doc_id")).alias("d"), (-F.col("first.nth")).alias("n"))).alias("s")
    cells = one.groupBy("entity", "topic").agg(strongest, F.count("*").alias("n_facts"))
    figures = one.select("entity", "topic", F.explode_outer(numbers(F.col("statement"))).alias("x")).groupBy("entity", "topic").agg(F.array_join(F.sort_array(F.collect_set("x")), ",").alias("numbers"))
    held = one.select("entity", "topic", F.explode("documents").alias("doc")).groupBy("entity", "topic").agg(F.count_distinct("doc").alias("n_documents"))
    topics = sorted(r.topic for r in cells.select("topic").distinct().collect())  # names of topics, a short list
    rows = one.select("entity").distinct() if entities is None else one.sparkSession.createDataFrame([(e,) for e in entities], "entity string")
    dense = rows.select("entity", F.explode(F.array(*[F.lit(t) for t in topics]) if topics else F.array().cast("array<string>")).alias("topic"))
    out = dense.join(cells, ["entity", "topic"], "left").join(figures, ["entity", "topic"], "left").join(held, ["entity", "topic"], "left")
    return out.select(
        "entity", "topic", F.col("n_facts").isNotNull().alias("has_evidence"), F.coalesce("n_facts", F.lit(0)).alias("n_facts"), F.coalesce(F.floor(F.col("s.strength") * 100 + 0.5), F.lit(0)).alias("strength"), F.col("s.statement").alias("statement"),
        F.coalesce("numbers", F.lit("")).alias("numbers"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
    )


def gaps(cells: DataFrame) -> DataFrame:
    """topic, n_with, n_without, complete, partial, missing (entities without, joined) of a matrix."""
    none = F.when(~F.col("has_evidence"), F.col("entity"))
    rows = cells.groupBy("topic").agg(F.count_if("has_evidence").alias("n_with"), F.count_if(~F.col("has_evidence")).alias("n_without"), F.array_join(F.sort_array(F.collect_set(none)), ",").alias("missing"))
    return rows.select("topic", "n_with", "n_without", (F.col("n_without") == 0).alias("complete"), ((F.col("n_with") > 0) & (F.col("n_without") > 0)).alias("partial"), "missing")
