"""Text operators: sentences, cleaning, claims, intents and extraction."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Topics and the terms that name them, first match wins.
TOPICS = [
    ("renewable_target", ["renewable share", "renewable electricity", "renewable generation", "electricity generation"]), ("solar_capacity", ["solar capacity", "solar"]), ("wind_capacity", ["wind capacity", "wind"]),
    ("investment", ["investment", "climate finance", "green bonds", "finance"]), ("hydrogen", ["hydrogen", "green hydrogen", "renewable hydrogen"]),
    ("transport", ["electric vehicle", "clean transport", "public transport", "transport"]), ("industry", ["industrial efficiency", "industry", "industrial"]),
    ("carbon_market", ["carbon market", "carbon registry", "registry", "mrv"]), ("net_zero", ["net zero", "net-zero", "emissions reduction"]),
]
#: Words of a question that choose a strategy, by falling priority.
RULES = {
    "COMPARE": ["compare", "comparison", "difference", "differences", "versus", " vs ", "vs."], "EXPLAIN": ["how", "why", "relationship", "related", "connected", "connection", "link", "linked"],
    "CLASSIFICATION": ["type", "category", "classify", "kind of", "form of"], "DEFINITION": ["what is", "what's", "define", "definition", "meaning of"], "FACT": ["what", "when", "where", "which", "who"],
}


#: Beginnings and parts of metadata lines, and dates, which keep a line.
METADATA_PREFIXES = [
    "country:", "jurisdiction:", "document type:", "publication date:", "effective date:", "issuing authority:", "authority:", "source class:", "language:", "version:",
    "page ", "page:", "chapter ", "section ", "table ", "figure ", "appendix", "copyright", "isbn", "doi",
]
METADATA_PARTS = [
    "synthetic test document", "document ingestion", "metadata", "citation validation", "development test document",
    "not an official government policy", "fictional, internally generated", "internal synthetic test material",
]
DATE = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{1,2} +[A-Za-z]+ +[0-9]{4}\b"


#: Runs that come from text decoded in the wrong way, and what signs they stand for.
MOJIBAKE = [r"ðŸ[^<\n\r]{0,8}", r"â€[^<\n\r]{0,3}", r"âœ[^<\n\r]{0,3}", r"â†[^<\n\r]{0,3}", r"â[^<\n\r]{0,4}", r"Â[^A-Za-z0-9\s<>/=\"-]{0,2}"]
MENDED = [
    ("â€”", "—"), ("â€“", "–"), ("â€œ", '"'), ("â€\x9d", '"'), ("â€˜", "'"), ("â€™", "'"), ("â€¦", "…"), ("â€¢", "•"), ("Â·", "·"), ("Â©", "©"), ("â‚‚", "₂"), ("â–¼", "▼"), ("â†\x90", "←"), ("â†’", "→"), ("âœ•", "✕"),
    ("âœ“", "✓"), ("âœ…", "✅"),
]


def bad_runs(df: DataFrame, column: str, most: int = 40) -> DataFrame:
    """pattern, n of the most frequent wrongly decoded runs of a column; a run counts once for each pattern that finds it."""
    found = F.concat(*[F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(p), F.lit(0)) for p in MOJIBAKE])
    return df.select(F.explode(found).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern").limit(most)


def mended(text: Column) -> Column:
    """A text with wrongly decoded signs put right, one kind after another."""
    for wrong, right in MENDED:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def is_metadata(line: Column) -> Column:
    """Whether a line (lower case, single spaces, trimmed) is metadata; the date rule comes before prefixes and parts."""
    named = line.rlike("^(" + "|".join(METADATA_PREFIXES) + ")") | line.rlike("|".join(METADATA_PARTS))
    return (line == "") | line.rlike("^page [0-9]+") | (~line.rlike(DATE) & named)


def limited(text: Column, most: int = 60_000) -> Column:
    """A text without outer white space; beyond `most` characters the first 75 % and the last 25 % of them, with a mark between."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    cut = F.concat(F.substring(clean, 1, most * 3 // 4), F.lit("\n\n[DOCUMENT MIDDLE OMITTED]\n\n"), F.right(clean, F.lit(most // 4)))
    return F.when(F.length(clean) <= most, clean).otherwise(cut)


def sentences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos, sentence: text cut after a full stop, question or exclamation mark and white space."""
    marked = F.regexp_replace("text", r"([.!?])[ \t\r\n]+", "$1\u0001")
    return docs.select(key, F.posexplode(F.split(marked, "\u0001")).alias("pos", "sentence")).where(F.trim("sentence") != "")


def kept_lines(text: str) -> list[tuple[int, str]]:
    """(place, line) of the lines that are no page number, no repeat of the line before and no repeated header (a short line without end mark)."""
    lines = [x.strip(" ") for x in text.split("\n")]
    often, out = Counter(lines), []
    for pos, line in enumerate(lines):
        number = re.fullmatch(r"(?i:page )?[0-9]+", line)
        header = often[line] >= 2 and len(line) <= 140 and not line.endswith((".", "!", "?")) and len(re.split(" +", line)) <= 16
        if line and not number and not header and not (pos and lines[pos - 1] == line):
            out.append((pos, line))
    return out


def cleaned_lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line of kept_lines() of docs(doc_id, text); what is kept depends on one document only, so nothing is shuffled."""
    def run(batches):
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                found = kept_lines(text.as_py() or "")
                for at in range(0, len(found), 4096):
                    part = found[at : at + 4096]
                    yield pa.RecordBatch.from_arrays([pa.repeat(doc, len(part)).cast(pa.int64()), pa.array([p for p, _ in part], pa.int32()), pa.array([x for _, x in part], pa.string())], names=["doc_id", "pos", "line"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, pos int, line string")


def topic(text: Column) -> Column:
    low, found = F.lower(text), F.lit(None).cast("string")
    for name, terms in reversed(TOPICS):
        hit = F.lit(False)
        for t in terms:
            hit = hit | low.contains(t)
        found = F.when(hit, name).otherwise(found)
    return F.coalesce(found, F.lit("general"))


def strategy(question: Column) -> Column:
    """The plan of a question: words are matched as substrings; refinement overrides priority."""
    q = F.lower(question)
    hit = {}
    for rule, words in RULES.items():
        hit[rule] = F.lit(False)
        for w in words:
            hit[rule] |= q.contains(w)
    hit["CLASSIFICATION"] |= q.rlike(r"\bis\b.+\ban?\b")
    return (
        F.when(hit["COMPARE"], "COMPARISON").when(hit["CLASSIFICATION"], "REASONING").when(hit["EXPLAIN"], "GRAPH")
        .when(hit["DEFINITION"], "ONTOLOGY").when(hit["FACT"], "SEMANTIC").otherwise("HYBRID")
    )


#: Currencies, scales and units of values in statements.
CURRENCIES = ["USD", "EUR", "GBP", "AED", "PKR", "SAR", "QAR", "OMR", "KWD", "BHD"]
SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}
UNITS = ["GW", "MW", "TW", "GWh", "MWh", "TWh", "kWh", "MtCO2e", "MtCO2", "tCO2e", "tCO2", "kgCO2e", "kgCO2", "tonnes", "tons", "ton", "kg", "km", "hectares"]
NUMBER = r"-?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"
MONEY = rf"(?i)\b({'|'.join(CURRENCIES)})\s*([0-9,]+(?:\.[0-9]+)?)\s*({'|'.join(SCALES)})?\b"
SHARE = rf"(?i)({NUMBER})\s*(%|percent|per cent)(?:\s|$|[.,;:!?])"
#: Longer units first, or "5 GWh" would be read as GW.
SIZE = rf"(?i)({NUMBER})\s*({'|'.join(sorted(UNITS, key=len, reverse=True))})\b"
YEARS = r"(?i)\b((?:19|20)[0-9]{2})\s*(?:-|–|—|to)\s*((?:19|20)[0-9]{2})\b"
BY_YEAR = r"(?i)\b(?:by|before|until|through|during|in)\s+((?:19|20)[0-9]{2})\b"


def structured_value(text: Column) -> Column:
    """struct(kind, number, unit, scale, amount, year, last_year) of a text, or null: a currency amount before a percentage, a measurement, a range of years, a year.

    number is as written, amount times its scale (currencies only). A year stands beside any kind: the one after by, before, until, through,
    during or in, else the only one. What looks like a number and is none (`USD .`, `1,2,,3`) has a null number, and as a currency counts
    as no amount.
    """
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    # no value is without a digit; what has one is cleaned once
    return F.when(text.rlike("[0-9]"), F.element_at(F.transform(F.array(clean), _structured), 1))


def _structured(clean: Column) -> Column:
    number = lambda p, g: F.replace(F.regexp_extract(clean, p, g), F.lit(","), F.lit("")).try_cast("double")
    own = lambda c, names: F.coalesce(*[F.when(F.lower(c) == x.lower(), x) for x in names])
    money, scale = number(MONEY, 2), F.lower(F.regexp_extract(clean, MONEY, 3))
    times = F.coalesce(*[F.when(scale == k, F.lit(v)) for k, v in SCALES.items()], F.lit(1.0))
    all_years = F.array_distinct(F.regexp_extract_all(clean, F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1)))
    single = F.when(clean.rlike(BY_YEAR), F.regexp_extract(clean, BY_YEAR, 1)).when(F.size(all_years) == 1, F.element_at(all_years, 1))
    none = F.lit(None)

    def made(kind, n=none, unit=none, own_scale=none, amount=none, year=single, last=none):
        parts = [(F.lit(kind), "kind", "string"), (n, "number", "double"), (unit, "unit", "string"), (own_scale, "scale", "string"), (amount, "amount", "double"), (year, "year", "int"), (last, "last_year", "int")]
        return F.struct(*[c.cast(t).alias(name) for c, name, t in parts])

    ranged = clean.rlike(YEARS)
    from_year, to_year = F.when(ranged, F.regexp_extract(clean, YEARS, 1)).otherwise(single), F.when(ranged, F.regexp_extract(clean, YEARS, 2))
    return (
        F.when(clean.rlike(MONEY) & money.isNotNull(), made("currency", money, F.upper(F.regexp_extract(clean, MONEY, 1)), F.nullif(scale, F.lit("")), money * times, from_year, to_year))
        .when(clean.rlike(SHARE), made("percentage", number(SHARE, 1), F.lit("%"), year=from_year, last=to_year))
        .when(clean.rlike(SIZE), made("measurement", number(SIZE, 1), own(F.regexp_extract(clean, SIZE, 2), UNITS), year=from_year, last=to_year))
        .when(ranged, made("year_range", year=from_year, last=to_year)).when(single.isNotNull(), made("year"))
    )
