"""From literal objects of facts to entities of a registry: discovery, duplicates, insertion plan, application, synchronisation.

registry(entity_id, name, type, aliases, candidates, occurrences), entity_id being a prefix and a number (E12); facts(rel_id, subject_id,
predicate, object, value_type, confidence, source) with literal objects; edges(subject_id, predicate, object_id, confidence) between entities.

Objects that say the same (by key: lower case, words only) are one. What a discovered entity duplicates is decided in one
pass: the registry's ids, keys, names, candidates and aliases form one index of (rule, key), a discovered entity asks for all its keys
at once, and the first rule that answers wins, in it the first key, then the first entity. New ids go on from the greatest one by
ranges of the discovered keys, so no task numbers all of them. Applying a plan twice adds nothing the second time.

Defined cases: null and empty objects are no entity; a null confidence counts as 0; repeated facts count once for each source;
facts whose subject is not in the registry are rejected and counted; empty tables give empty plans and a report of zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.graph import written
from factloom.operators.numbering import numbered

#: Beginnings of action phrases, kinds of values that are literals, and values that name nothing.
ACTIONS = [
    "adopting", "building", "creating", "developing", "establishing", "expanding", "financing", "funding", "implementing", "improving", "investing", "mobilizing", "promoting", "reducing", "supporting",
    "targeting",
]
LITERALS = ["percentage", "currency", "number", "date", "year", "duration", "temperature", "distance", "weight"]
GENERIC = ["none", "null", "unknown", "not available", "not applicable", "n a", "na", "yes", "no", "true", "false"]
#: Words that make an object an entity, and the kinds that words stand for, in order.
SEMANTIC = (
    "fund|bond|policy|strategy|framework|plan|project|programme|program|initiative|authority|agency|ministry|bank|solar|wind|renewable|hydrogen|energy|market|mechanism"
)
KINDS = [
    ("financial_concept", "fund|bond|finance|investment"), ("energy_concept", "solar|wind|renewable|hydrogen|energy"), ("policy_concept", "policy|strategy|framework|plan"),
    ("initiative", "project|programme|program|initiative"), ("organization", "organization|authority|agency|ministry|bank"),
]
RULES = ["node_id", "entity_id", "canonical_key", "canonical_name", "candidate_id", "alias"]
LEAST, MOST_TOKENS = 0.72, 12


def key_of(value: Column) -> Column:
    """A value in lower case, words and signs of money only."""
    low = F.lower(F.coalesce(value, F.lit("")))
    # words with one space between them are their own key
    return F.trim(F.when(low.rlike("[^a-z0-9%$€£ ]|  "), F.regexp_replace(low, "[^a-z0-9%$€£]+", " ")).otherwise(low))


def identifier(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(value, F.lit(""))), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def titled(value: Column) -> Column:
    """A value whose words begin with capitals."""
    return F.array_join(F.transform(F.split(F.trim(value), r"\s+"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 2_000_000_000))), " ")


def is_numeric(value: Column) -> Column:
    left = F.trim(F.coalesce(value, F.lit("")))
    for pattern in ("[$€£,%]", r"(?i)\b(?:usd|eur|gbp|pkr|million|billion|trillion)\b", r"(?i)\b(?:by|in|from|to)\b", r"[0-9]{4}", r"[0-9.\-–—\s]"):
        left = F.regexp_replace(left, pattern, "")
    return (F.trim(F.coalesce(value, F.lit(""))) != "") & (F.trim(left) == "")


def discovered(facts: DataFrame, least: float = LEAST) -> DataFrame:
    """key, name, type, candidate_id, n_sources, score, reasons (why it is none, joined; '' if it may be one), eligible of every object of the facts."""
    rows = facts.where(F.trim(F.coalesce("object", F.lit(""))) != "")
    # keys are made of distinct objects; of equal ones the least number stands for all, or none if one has none
    least_id = F.when(F.count_if(F.col("rel_id").isNull()) == 0, F.min("rel_id")).alias("rel_id")
    spelled = written(rows.groupBy("object", "value_type").agg(least_id).withColumn("key", key_of(F.col("object"))))
    first = spelled.groupBy("key").agg(F.min(F.struct("rel_id", "object", "value_type")).alias("first"))
    said = rows.select("object", "source").join(spelled.select("object", "key").distinct(), "object").groupBy("key").agg(F.count_distinct("source").alias("n_sources"))
    objects = first.join(said, "key").select("key", F.trim("first.object").alias("object"), F.lower(F.col("first.value_type")).alias("value_type"), "n_sources")
    n = F.size(F.filter(F.split("key", " "), lambda x: x != ""))
    literal, numeric = F.coalesce(F.col("value_type").isin(LITERALS), F.lit(False)), is_numeric(F.col("object"))
    sentence = (n > 14) | F.col("object").rlike(r"[.!?]$")
    action = F.col("key").rlike("^(?:" + "|".join(ACTIONS) + ")(?: |$)")
    reasons = F.array_compact(F.array(
        F.when(F.col("key") == "", "empty"), F.when(F.col("key").isin(GENERIC), "generic"), F.when(n < 1, "short"), F.when(n > MOST_TOKENS, "long"), F.when(numeric, "numeric"), F.when(sentence, "sentence"), F.when(literal, "literal"),
    ))
    parts = [
        (n.between(2, 8), F.lit(0.16)), (n == 1, F.lit(0.05)), (action, F.lit(0.08)), (F.col("n_sources") > 0, F.least(F.lit(0.14), F.col("n_sources") * 0.04)), (F.col("object").rlike(f"(?i)(?:{SEMANTIC})"), F.lit(0.14)),
        (literal, F.lit(-0.24)), (numeric, F.lit(-0.35)), (sentence, F.lit(-0.2)),
    ]
    score = F.lit(0.4)
    for hit, weight in parts:
        score = score + F.when(hit, weight).otherwise(0.0)
    kind = F.lit("concept")
    for name, words in reversed(KINDS):
        kind = F.when(F.col("key").rlike(words), name).otherwise(kind)
    made = objects.select("key", titled(F.col("object")).alias("name"), kind.alias("type"), "n_sources", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("score"), F.array_join(reasons, ",").alias("reasons"))
    made = made.withColumn("candidate_id", F.concat(identifier(F.col("type")), F.lit("_"), identifier(F.col("name"))))
    return made.withColumn("eligible", (F.col("reasons") == "") & (F.col("score") >= least))


def _rules(*columns: Column) -> Column:
    """An array of (rule, nth, key) structs from the key columns (arrays) of the rules."""
    return F.filter(F.flatten(F.array(*[_ruled(c, rule) for rule, c in enumerate(columns)])), lambda x: F.coalesce(x["key"], F.lit("")) != "")


def _ruled(keys: Column, rule: int) -> Column:
    return F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(rule).alias("rule"), i.alias("nth"), x.alias("key")))


def duplicates(found: DataFrame, registry: DataFrame) -> DataFrame:
    """key, entity_id, match of the eligible entities that the registry has already: the first rule, key and entity that fits."""
    none = F.array().cast("array<string>")
    number = F.regexp_extract("entity_id", r"([0-9]+)$", 1).try_cast("long")
    held = registry.select("entity_id", number.alias("seq"), F.explode(_rules(none, F.array(key_of(F.col("entity_id"))), F.array(key_of(F.col("name"))), F.array(key_of(F.col("name"))), F.transform("candidates", identifier), F.transform("aliases", key_of))).alias("r"))
    held = held.select("entity_id", "seq", "r.rule", "r.key")
    asked = found.where("eligible").select(F.col("key").alias("own"), F.explode(_rules(none, none, F.array("key"), F.array(key_of(F.col("name"))), F.array(identifier(F.col("candidate_id"))), F.array("key"))).alias("r")).select("own", "r.*")
    hits = asked.join(held, ["rule", "key"]).groupBy("own").agg(F.min(F.struct("rule", "nth", F.coalesce("seq", F.lit(0)).alias("seq"), "entity_id")).alias("m"))
    return hits.select(F.col("own").alias("key"), "m.entity_id", F.element_at(F.array(*[F.lit(r) for r in RULES]), F.col("m.rule") + 1).alias("match"))


def mapped(found: DataFrame, registry: DataFrame, prefix: str = "E") -> dict[str, DataFrame]:
    """The tables of a plan that need no facts beside what was discovered in them: discovered, duplicates, entities (to insert), mapping."""
    double = written(duplicates(found, registry))
    fresh = found.where("eligible").join(double, "key", "left_anti")
    top = registry.agg(F.max(F.regexp_extract("entity_id", r"([0-9]+)$", 1).try_cast("long"))).first()[0] or 0
    new = written(numbered(fresh, ["key"], "number", top + 1).withColumn("entity_id", F.concat(F.lit(prefix), "number")))
    mapping = written(double.select("key", "entity_id", "match").unionByName(new.select("key", "entity_id", F.lit("new").alias("match"))))
    return {"discovered": found, "duplicates": double, "entities": new, "mapping": mapping}


def plan(facts: DataFrame, registry: DataFrame, edges: DataFrame, least: float = LEAST, prefix: str = "E") -> dict[str, DataFrame]:
    """Named tables of an augmentation: discovered, duplicates, entities (to insert), mapping, relationships (to insert), rejected, report."""
    made = mapped(written(discovered(facts, least)), registry, prefix)
    found, double, new, mapping = made["discovered"], made["duplicates"], made["entities"], made["mapping"]
    score = found.select("key", "score")
    rows = facts.select("rel_id", "subject_id", F.upper(F.regexp_replace(F.trim("predicate"), "[^A-Za-z0-9]+", "_")).alias("predicate"), key_of(F.col("object")).alias("key"), F.coalesce("confidence", F.lit(0.0)).alias("own"))
    rows = rows.join(mapping.select("key", F.col("entity_id").alias("object_id")), "key").join(score, "key")
    known = registry.select(F.col("entity_id").alias("subject_id")).distinct()
    rejected = written(rows.join(known, "subject_id", "left_anti").select("rel_id", "subject_id", "predicate", "object_id"))
    both = F.when((F.col("own") > 0) & (F.col("score") > 0), F.col("own") * F.col("score")).otherwise(F.greatest("own", "score"))
    asked = rows.join(known, "subject_id", "left_semi").where((F.coalesce("predicate", F.lit("")) != "") & (F.col("subject_id") != F.col("object_id"))).withColumn("confidence", F.round(both, 6))
    wanted = written(asked.groupBy("subject_id", "predicate", "object_id").agg(F.min(F.struct("rel_id", "confidence")).alias("f"), F.count("*").alias("n_facts")).select("subject_id", "predicate", "object_id", "f.rel_id", "f.confidence", "n_facts"))
    links = written(wanted.join(edges.select("subject_id", "predicate", "object_id").distinct(), ["subject_id", "predicate", "object_id"], "left_anti"))
    counts = [
        ("objects", found), ("eligible", found.where("eligible")), ("entities_inserted", new), ("relationships_planned", wanted), ("relationships_inserted", links), ("relationships_skipped", wanted.join(links, ["subject_id", "predicate", "object_id"], "left_anti")),
        ("facts_rejected", rejected), *[(f"duplicates_{r}", double.where(F.col("match") == r)) for r in RULES],
    ]
    report = counts[0][1].agg(F.lit(counts[0][0]).alias("figure"), F.count("*").alias("n"))
    for name, rows in counts[1:]:
        report = report.unionByName(rows.agg(F.lit(name).alias("figure"), F.count("*").alias("n")))
    return {**made, "relationships": links, "rejected": rejected, "report": report}


def extended(made: dict[str, DataFrame], registry: DataFrame) -> DataFrame:
    """The registry after a plan; what was there stays as it is."""
    new = made["entities"].select("entity_id", "name", "type", F.array().cast("array<string>").alias("aliases"), F.array("candidate_id").alias("candidates"), F.lit(1).cast("long").alias("occurrences"))
    return registry.select(*new.columns).unionByName(new)


def applied(made: dict[str, DataFrame], registry: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry and edges after a plan; what was there stays as it is."""
    return extended(made, registry), edges.select("subject_id", "predicate", "object_id", "confidence").unionByName(made["relationships"].select("subject_id", "predicate", "object_id", "confidence"))


def merged(first: DataFrame, more: DataFrame) -> DataFrame:
    """key, name, aliases, candidates, occurrences of entities of both tables by key: unions of their lists, sums of their counts, the name of the first."""
    both = first.select("name", "aliases", "candidates", "occurrences", F.lit(0).alias("side")).unionByName(more.select("name", "aliases", "candidates", "occurrences", F.lit(1).alias("side")))
    rows = both.withColumn("key", key_of(F.col("name"))).where("key <> ''")
    union = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))))
    return rows.groupBy("key").agg(F.min(F.struct("side", "name")).alias("n"), union("aliases").alias("aliases"), union("candidates").alias("candidates"), F.sum(F.coalesce("occurrences", F.lit(0))).alias("occurrences")).select("key", "n.name", "aliases", "candidates", "occurrences")


def object_links(facts: DataFrame, mapping: DataFrame) -> DataFrame:
    """key, entity_id, match, occurrences, confidence (greatest) of every object that stands for an entity."""
    # keys are made of distinct objects
    objects = facts.select("object", F.coalesce("confidence", F.lit(0.0)).alias("confidence")).groupBy("object").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))
    rows = objects.groupBy(key_of(F.col("object")).alias("key")).agg(F.sum("n").alias("occurrences"), F.max("confidence").alias("confidence"))
    return rows.join(mapping, "key").select("key", "entity_id", "match", "occurrences", "confidence")
