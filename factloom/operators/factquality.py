"""How much a statement is worth as a fact: 100 points less what speaks against it, with the reasons.

Defined cases: a null or empty statement scores 0 and is `empty_statement`; scores stay between 0 and 100; statements of ACCEPTED
points or more are kept. Phrases that mark internal tests can be added to.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beginnings of metadata, headings, phrases of internal tests, incomplete ends, phrases that say nothing.
METADATA = [
    "country:", "country ", "jurisdiction:", "jurisdiction ", "document type:", "document type ", "source class:", "source class ", "publication date:", "publication date ", "effective date:", "effective date ", "issuing authority:",
    "issuing authority ", "authority:", "language:", "language ", "version:", "page:", "page ", "section:", "chapter:", "table:", "figure:", "appendix:",
]
HEADINGS = [
    "executive summary$", "general overview$", "strategic targets(?: and milestones)?$", "target hierarchy$", "sector programs?$", "grid modernization$", "finance$", "transport$", "industry$", "agriculture(?: and methane)?$",
    "carbon markets?(?: and digital mrv)?$", "implementation$", "governance$", "test questions?", "key [0-9]{4} outcomes?$", r"indicator\b",
]
INTERNAL = [
    "synthetic test document", "synthetic policy framework", "fictional, internally generated", "fictional internally generated", "document ingestion", "retrieval, metadata and citation validation", "citation validation",
    "development test document", "do not cite as an official policy", "not an official government policy",
]
UNFINISHED = [",", ":", ";", "-", "–", "—", "(", "/"]
LITTLE = ["english", "federal", "global", "internal", "strategy", "other", "unknown", "not available"]
VERB = (
    r"(?i)\b(?:is|are|was|were|be|been|being|has|have|had|will|would|shall|should|aims?|targets?|plans?|supports?|establishes?|requires?|includes?|focuses?|seeks?|provides?|reduces?|increases?|mobilizes?|produces?|covers?|applies?|operates?"
    r"|launches?|develops?|introduces?|expects?|prioritizes?)\b"
)
FIGURE = r"(?i)\b[0-9]+(?:[,.][0-9]+)?\s*(?:%|percent|mw|gw|tw|usd|aed|pkr|eur|gbp|tonnes?|tons?|tco2e|mtco2e|gtco2e|years?)?\b"
NUMBER = r"\b[0-9]+(?:\.[0-9]+)?%?\b"
QUESTION = r"(?i)\?$|^[0-9]+\s+(?:what|when|where|which|who|why|how)\b"
#: Points against each fault, points for a verb and a figure, and what is accepted.
POINTS = {"metadata": 90, "heading": 70, "internal_test_content": 75, "question": 80, "table_row": 45, "fragment": 45, "low_information": 60}
WITH_VERB, WITH_FIGURE, ACCEPTED = 10, 5, 45


def _by_letter(pattern: str) -> str:
    """A pattern of whole words (some ending in s?) with its words grouped by first letters, so that few are tried where none begins."""
    head, tail = r"(?i)\b(?:", r")\b"
    words = sorted(pattern.removeprefix(head).removesuffix(tail).split("|"))
    return head + "|".join(f"{letter}(?:{'|'.join(w[1:] for w in own)})" for letter, own in groupby(words, key=lambda w: w[0])) + tail


def _contains(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(x) for x in parts])


def _spaced(text: Column) -> Column:
    """A text with single spaces; most have no others."""
    return F.when(text.contains("  ") | text.rlike("[\t\n\x0b\f\r]"), F.regexp_replace(text, r"\s+", " ")).otherwise(text)


def judged(rows: DataFrame, column: str = "statement", internal: list[str] | None = None) -> DataFrame:
    """rows with score, accepted and reasons of the statements in a column. Texts, tests and faults are made one after another, each once a row."""
    own = rows.columns
    made = rows.withColumn("q_value", F.trim(_spaced(F.replace(F.coalesce(F.col(column), F.lit("")), F.lit("\x00"), F.lit("")))))
    unquoted = F.trim(F.regexp_replace(F.regexp_replace(F.lower("q_value"), "[“”‘’\"'`]", ""), r"\s+", " "))
    made = made.withColumn("q_low", F.when(_contains(F.col("q_value"), list("“”‘’\"'`")), unquoted).otherwise(F.lower("q_value"))).withColumn("q_words", F.size(F.split("q_value", " ")))
    made = made.withColumn("q_verb", F.col("q_value").rlike(_by_letter(VERB))).withColumn("q_figure", F.col("q_value").rlike(FIGURE))
    text, low, n, verb, figure = F.col("q_value"), F.col("q_low"), F.col("q_words"), F.col("q_verb"), F.col("q_figure")
    # a word is no title word if it has more than three letters or digits and begins with a small letter
    titled = ~text.rlike("(?:^| )[^A-Za-z0-9 -]*(?:[a-z-][^ A-Za-z0-9-]*)(?:[A-Za-z0-9-][^ A-Za-z0-9-]*){3}")
    begins = lambda words: reduce(lambda a, b: a | b, [low.startswith(w) for w in words])
    # the patterns of questions and table rows read only texts with a sign of them
    asks, bars = text.contains("?") | F.substring(text, 1, 1).between("0", "9"), text.contains("|")
    faults = {
        "metadata": begins(METADATA) | (low == ""), "heading": text.rlike("(?i)^(?:" + "|".join(HEADINGS) + ")") | ((n <= 8) & ~text.rlike("[.!?]$") & ~verb & titled),
        "internal_test_content": _contains(low, [*INTERNAL, *(internal or [])]), "question": asks & text.rlike(QUESTION), "table_row": (bars & (F.regexp_count(text, F.lit("[|]")) >= 2)) | ((n <= 12) & ~verb & (F.regexp_count(text, F.lit(NUMBER)) >= 3)),
        "fragment": (n < 4) | F.right(text, F.lit(1)).isin(UNFINISHED) | ((n < 8) & ~verb & ~figure), "low_information": low.isin(LITTLE) | ~low.rlike("(?:[a-z][^a-z]*){5}"),
    }
    made = made.withColumns({f"q_{name}": hit for name, hit in faults.items()})
    less = reduce(lambda a, b: a + b, [F.when(F.col(f"q_{name}"), POINTS[name]).otherwise(0) for name in faults])
    told = F.concat_ws(",", *[F.when(F.col(f"q_{name}"), F.lit(name)) for name in faults])
    score = F.least(F.lit(100), F.greatest(F.lit(0), 100 - less + F.when(verb, WITH_VERB).otherwise(0) + F.when(figure, WITH_FIGURE).otherwise(0)))
    made = made.withColumn("score", F.when(text == "", 0).otherwise(score))
    return made.select(*own, "score", (F.col("score") >= ACCEPTED).alias("accepted"), F.when(text == "", "empty_statement").otherwise(told).alias("reasons"))


def rejections(judged: DataFrame) -> DataFrame:
    """reason, n of the rejected statements of a table with accepted and reasons."""
    # counted first: a filter would go below the judging, which would then be done twice for every statement
    rows = judged.groupBy("reasons").agg(F.count_if(~F.col("accepted")).alias("n")).where("n > 0")
    return rows.select(F.explode(F.split("reasons", ",")).alias("reason"), "n").groupBy("reason").agg(F.sum("n").alias("n"))
