"""Queries on propositions of texts, each with SQL that must give the same rows.

Nulls: a null text has no propositions. Ties end in places, which are unique in a text. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import factquality as q
from factloom.operators import propositions as p
from factloom.operators import text
from factloom.plans.catalog import query, view

_FOUND = ", ".join(rf"{{'at': CASE WHEN regexp_matches(c, '(?i)\b(?:{x})\b') THEN length(regexp_extract(c, '(?is)^(.*?)\b(?:{x})\b', 1)) ELSE 999999 END, 'k': {k}, 'p': regexp_extract(c, '(?i)\b({x})\b', 1)}}" for k, x in enumerate(p.PREDICATES))
_SUBJECT = "coalesce(" + ", ".join(f"CASE WHEN starts_with(lower(c), '{s.lower()}') THEN c[1:{len(s)}] END" for s in p.SUBJECTS) + ", " + ", ".join(f"nullif(trim(regexp_extract(c, '{x}', 1)), '')" for x in p.NAMED) + ")"


def _safe(column: str) -> str:
    for k, phrase in enumerate(p.PROTECTED):
        column = rf"regexp_replace({column}, '(?i)\b{phrase}\b', '__P{k}__', 'g')"
    return column


def _restored(column: str) -> str:
    for k, phrase in enumerate(p.PROTECTED):
        column = f"replace({column}, '__P{k}__', '{phrase}')"
    return column


_CLEAN = r"trim(regexp_replace(regexp_replace(trim({}), '(?i)^(?:and|or|as well as)\s+', ''), '[.;:!?]+$', ''))"
_SQL = rf"""
WITH s AS (
  SELECT doc_id, unnest(parts) AS whole, generate_subscripts(parts, 1) - 1 AS sentence FROM (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM policies)
), cl AS (
  SELECT doc_id, sentence, whole, unnest(ps) AS c, generate_subscripts(ps, 1) - 1 AS part FROM (SELECT *, list_filter(list_transform(string_split_regex(whole, '[;•]'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM s)
), f AS (
  SELECT *, {_SUBJECT} AS named, list_sort([{_FOUND}])[1] AS first, lag(whole) OVER (PARTITION BY doc_id ORDER BY sentence, part) IS DISTINCT FROM whole AS new FROM cl
), g AS (
  SELECT *, CASE WHEN first['at'] < 999999 THEN first['p'] END AS said, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY sentence, part) AS run FROM f
), h AS (
  SELECT *, last_value(named IGNORE NULLS) OVER (PARTITION BY doc_id, run ORDER BY sentence, part) AS subject, last_value(said IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY sentence, part) AS held FROM g
), i AS (
  SELECT *, CASE WHEN said IS NOT NULL THEN 'explicit' WHEN held IS NOT NULL AND (regexp_matches(c, '{p.CONTINUES}') OR NOT regexp_matches(c, '{p.STRONG}')) THEN 'inherited' ELSE 'missing' END AS source FROM h
), j AS (
  SELECT *, CASE WHEN source <> 'missing' THEN held END AS predicate, trim(CASE WHEN source <> 'missing' THEN regexp_replace(c, '(?is)^.*?\b' || held || '\b', '') ELSE c END) AS o FROM i
), k0 AS (
  SELECT *, list_filter(list_transform(string_split(regexp_replace({_safe("o")}, '(?i),\s*(?:and|or)\s+', ',', 'g'), ','), lambda x: {_CLEAN.format("x")}), lambda x: x <> '') AS bare FROM j
), k AS (
  SELECT *, list_filter(list_transform(bare, lambda x: {_CLEAN.format(_restored("x"))}), lambda x: length(x) >= 2) AS items FROM k0
), l AS (
  SELECT *, contains(o, ',') AND regexp_matches(o, '(?i)\s(?:and|or)\s+') AND len(regexp_extract_all(o, '{p.INDEPENDENT}')) <= 1 AND len(items) >= 2 AS expanded FROM k
), m AS (
  SELECT doc_id, sentence, part, subject, predicate, source, expanded, unnest(CASE WHEN expanded THEN items ELSE [{_CLEAN.format("o")}] END) AS object, unnest(CASE WHEN expanded THEN range(0, len(items)) ELSE [0] END) AS item FROM l
), v AS (
  SELECT *, CASE WHEN regexp_matches(object, '{text.MONEY}') THEN 'currency' WHEN regexp_matches(object, '{text.SHARE}') THEN 'percentage' WHEN regexp_matches(object, '{text.SIZE}') THEN 'measurement' WHEN regexp_matches(object, '\b(?:19|20)[0-9]{{2}}\b') THEN 'year' END AS kind,
         regexp_matches(object, '\b(?:19|20)[0-9]{{2}}\b') AS dated FROM m
), w AS (
  SELECT *, CASE kind WHEN 'currency' THEN TRY_CAST(regexp_extract(object, '{text.MONEY}', 2) AS DOUBLE) WHEN 'percentage' THEN TRY_CAST(regexp_extract(object, '{text.SHARE}', 1) AS DOUBLE) WHEN 'measurement' THEN TRY_CAST(regexp_extract(object, '{text.SIZE}', 1) AS DOUBLE) END AS number FROM v
)
SELECT doc_id, sentence, part, item, subject, predicate, source, nullif(object, '') AS object, kind, number,
       round((2 * CASE WHEN subject IS NULL THEN 0E0 WHEN length(subject) > 2 THEN 1E0 ELSE 0.7E0 END + 2 * CASE WHEN predicate IS NULL THEN 0E0 ELSE 1E0 END + 2 * CASE WHEN object = '' THEN 0E0 WHEN length(object) > 3 THEN 1E0 ELSE 0.7E0 END
         + CASE WHEN kind IS NULL THEN 0.5E0 ELSE 0.5E0 + CASE WHEN number IS NOT NULL THEN 0.2E0 ELSE 0 END + CASE WHEN kind <> 'year' THEN 0.1E0 ELSE 0 END + CASE WHEN dated THEN 0.1E0 ELSE 0 END END
         + CASE WHEN expanded THEN 0.95E0 ELSE 1E0 END + 0.95E0 + 2 * CASE source WHEN 'missing' THEN 0.5E0 WHEN 'inherited' THEN 0.95E0 ELSE 1E0 END) / 11E0, 3) AS confidence,
       subject IS NOT NULL AND predicate IS NOT NULL AND object <> '' AS valid, array_to_string(list_filter([CASE WHEN subject IS NULL THEN 'subject' END, CASE WHEN predicate IS NULL THEN 'predicate' END, CASE WHEN object = '' THEN 'object' END], lambda x: x IS NOT NULL), ',') AS missing
FROM w"""



@query("txt4_propositions", _SQL)
def txt4(s, d):
    """Every proposition of every policy, with its confidence and what it lacks."""
    return p.propositions(view(s, d, "policies"))


@query("txt15_knowledge", f"SELECT subject, upper(regexp_replace(predicate, '\\s+', '_', 'g')) AS predicate, count(*) AS n, count(DISTINCT object) AS n_objects, round(max(confidence), 3) AS best, count(*) FILTER (confidence >= 0.9) AS n_sure, count(number) AS n_values FROM ({_SQL}) WHERE valid GROUP BY 1, 2")
def txt15(s, d):
    """What the valid propositions of all policies say of each subject, by predicate."""
    rows = p.propositions(view(s, d, "policies")).where("valid")
    return rows.groupBy("subject", F.upper(F.regexp_replace("predicate", r"\s+", "_")).alias("predicate")).agg(F.count("*").alias("n"), F.count_distinct("object").alias("n_objects"), F.max("confidence").alias("best"), F.count_if(F.col("confidence") >= 0.9).alias("n_sure"), F.count("number").alias("n_values"))


def _any(words: list[str], test: str) -> str:
    return "(" + " OR ".join(test.format(w.replace("'", "''")) for w in words) + ")"


_LINES = r"""lines AS (SELECT doc_id, nth, x AS value, trim(regexp_replace(regexp_replace(lower(x), '[“”‘’"''`]', '', 'g'), '\s+', ' ', 'g')) AS low, string_split(x, ' ') AS ws
  FROM (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS nth FROM reports))"""
_FAULTS = rf"""WITH {_LINES}, t AS (
  SELECT *, regexp_matches(value, '{q.VERB}') AS verb, regexp_matches(value, '{q.FIGURE}') AS figure FROM lines
), f AS (
  SELECT *, {_any(q.METADATA, "starts_with(low, '{}')")} OR low = '' AS metadata, regexp_matches(value, '(?i)^(?:{"|".join(q.HEADINGS)})') OR (len(ws) <= 8 AND NOT regexp_matches(value, '[.!?]$') AND NOT verb
           AND len(list_filter(list_transform(ws, lambda w: regexp_replace(w, '[^A-Za-z0-9-]', '', 'g')), lambda w: NOT (w = '' OR regexp_matches(w, '^[A-Z0-9]') OR length(w) <= 3))) = 0) AS heading,
         {_any(q.INTERNAL, "contains(low, '{}')")} AS internal, regexp_matches(value, '{q.QUESTION}') AS question, len(regexp_extract_all(value, '[|]')) >= 2 OR (len(regexp_extract_all(value, '{q.NUMBER}')) >= 3 AND len(ws) <= 12 AND NOT verb) AS table_row,
         len(ws) < 4 OR value[-1] IN (',', ':', ';', '-', '–', '—', '(', '/') OR (len(ws) < 8 AND NOT verb AND NOT figure) AS fragment, low IN ('english', 'federal', 'global', 'internal', 'strategy', 'other', 'unknown', 'not available') OR length(regexp_replace(low, '[^a-z]', '', 'g')) < 5 AS little
  FROM t
), s AS (
  SELECT doc_id, nth, CASE WHEN value = '' THEN 0 ELSE least(100, greatest(0, 100 - CASE WHEN metadata THEN 90 ELSE 0 END - CASE WHEN heading THEN 70 ELSE 0 END - CASE WHEN internal THEN 75 ELSE 0 END - CASE WHEN question THEN 80 ELSE 0 END - CASE WHEN table_row THEN 45 ELSE 0 END
           - CASE WHEN fragment THEN 45 ELSE 0 END - CASE WHEN little THEN 60 ELSE 0 END + CASE WHEN verb THEN 10 ELSE 0 END + CASE WHEN figure THEN 5 ELSE 0 END)) END AS score,
         CASE WHEN value = '' THEN 'empty_statement' ELSE array_to_string(list_filter([CASE WHEN metadata THEN 'metadata' END, CASE WHEN heading THEN 'heading' END, CASE WHEN internal THEN 'internal_test_content' END, CASE WHEN question THEN 'question' END,
           CASE WHEN table_row THEN 'table_row' END, CASE WHEN fragment THEN 'fragment' END, CASE WHEN little THEN 'low_information' END], lambda x: x IS NOT NULL), ',') END AS reasons FROM f
)"""


def _lines(s, d):
    # outer: else Spark would make every text a second time, to see whether it has lines
    rows = view(s, d, "reports").select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("nth", "line")).where("nth is not null")
    return q.judged(rows, "line").drop("line")


@query("flt9_fact_quality", f"{_FAULTS} SELECT doc_id, nth, score, score >= 45 AS accepted, reasons FROM s")
def flt9(s, d):
    """Every line of every report as a fact: points, and what speaks against it."""
    return _lines(s, d)


@query("flt9_rejections", f"{_FAULTS} SELECT unnest(string_split(reasons, ',')) AS reason, count(*) AS n FROM s WHERE score < 45 GROUP BY 1")
def flt9_rejections(s, d):
    return q.rejections(_lines(s, d))


@query("flt10_validity", f"SELECT coalesce(nullif(missing, ''), 'valid') AS reason, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM ({_SQL}) GROUP BY 1")
def flt10(s, d):
    """Propositions by what they lack."""
    return p.propositions(view(s, d, "policies")).groupBy(F.coalesce(F.nullif("missing", F.lit("")), F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))
