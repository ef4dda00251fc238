"""Queries on the inside of documents: content blocks and chunks, each with SQL that must give the same rows.

Nulls: a null text is empty. Ties end in positions, which are unique in a document. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import chunking
from factloom.plans.catalog import query, table, view
from factloom.streaming import processing

_SMALL = "['" + "', '".join(chunking.SMALL_WORDS) + "']"
_VERBS = "|".join(chunking.SENTENCE_WORDS)
_ANY_MARK = r"^([0-9]+[.)]|[" + chunking.BULLETS.replace("-", r"\-") + r"]|[a-zA-Z][.)]) .+$"


def _bare(c: str) -> str:
    return rf"trim(regexp_replace({c}, '[:;,.!?]+$', ''))"


def _words(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda w: w <> '')"


def _title(c: str) -> str:
    kept = f"list_filter(list_transform({_words(c)}, lambda w: regexp_replace(w, '[^a-zA-Z0-9''-]', '', 'g')), lambda w: w <> '')"
    return f"(len({_words(c)}) BETWEEN 1 AND 12 AND len({kept}) > 0 AND 5 * len(list_filter({kept}, lambda w: list_contains({_SMALL}, lower(w)) OR regexp_full_match(w, '[A-Z0-9][A-Za-z0-9''-]*'))) >= 4 * len({kept}))"


def _sentence(c: str) -> str:
    return rf"(regexp_matches({c}, '[.!?]$') OR len({_words(c)}) > 14 OR regexp_matches({c}, '(?i)\b({_VERBS})\b'))"


# The open headings in closed form: the first one stays, the k-th leaves min(3, k) open ones, a numbered one (not the first) leaves two.
_BLOCKS = rf"""
WITH l AS (
  SELECT doc_id, line, trim(regexp_replace(replace(raw, chr(160), ' '), '[ \t]+', ' ', 'g')) AS x
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM reports)
), n AS (
  SELECT *, lag(x, 1, '') OVER (PARTITION BY doc_id ORDER BY line) AS before, coalesce(first_value(nullif(x, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS following,
         CASE WHEN regexp_matches(x, '^[0-9]+[.)] .+$') THEN 'number' WHEN regexp_matches(x, '^[{chunking.BULLETS.replace("-", chr(92) + "-")}] .+$') THEN 'bullet' WHEN regexp_matches(x, '^[a-zA-Z][.)] .+$') THEN 'letter' END AS mark_type
  FROM l
), m AS (
  SELECT *, CASE WHEN mark_type IS NOT NULL THEN trim(regexp_extract(x, '^[^ ]+ (.+)$', 1)) ELSE x END AS content, CASE WHEN mark_type = 'bullet' THEN x[1] WHEN mark_type IS NOT NULL THEN regexp_extract(x, '^([0-9a-zA-Z]+)', 1) END AS mark FROM n WHERE x <> ''
), h AS (
  SELECT *, {_bare("content")} AS b FROM m
), c AS (
  SELECT *, CASE mark_type WHEN 'number' THEN len({_words("b")}) <= 8 AND {_title("b")} AND NOT {_sentence("b")} WHEN 'bullet' THEN false WHEN 'letter' THEN false
         ELSE {_title("b")} AND ((regexp_matches(following, '{_ANY_MARK}') AND len({_words("b")}) <= 6) OR (NOT {_sentence("b")} AND (before = '' OR following = '' OR len({_words("b")}) <= 4))) END AS heading
  FROM h
), k AS (
  SELECT *, count(*) FILTER (heading) OVER w AS nth, max(line) FILTER (heading AND mark_type IS NOT NULL) OVER w AS section FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY line)
), s AS (
  SELECT *, CASE WHEN NOT heading THEN NULL WHEN nth = 1 THEN 1 WHEN mark_type IS NOT NULL THEN 2 ELSE least(3, nth, 2 + coalesce(nth - max(CASE WHEN nth > 1 AND heading AND mark_type IS NOT NULL THEN nth END) OVER w, nth)) END AS depth
  FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line)
), p AS (
  SELECT *, last_value(depth IGNORE NULLS) OVER w AS open, max(CASE WHEN depth = 1 THEN b END) OVER w AS h1, last_value(CASE WHEN depth = 2 THEN b END IGNORE NULLS) OVER w AS h2, last_value(CASE WHEN depth = 3 THEN b END IGNORE NULLS) OVER w AS h3
  FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY line)
)
SELECT doc_id, CAST(line AS BIGINT) AS line, CASE WHEN mark_type IS NULL THEN 'paragraph' ELSE 'listItem' END AS type, content,
       CASE WHEN open IS NULL THEN '' ELSE concat_ws(' > ', h1, CASE WHEN open >= 2 THEN h2 END, CASE WHEN open >= 3 THEN h3 END) END AS path, mark_type, mark
FROM p WHERE NOT heading"""


@query("win5_context_blocks", _BLOCKS)
def win5(s, d):
    """Paragraphs and list items of every report with the headings above them."""
    return chunking.context_blocks(view(s, d, "reports")).withColumn("path", F.array_join("path", " > "))


def chunk_sql(sizes: chunking.Sizes, source: str = "reports", content: str = "text") -> str:
    """Chunks by recursion over pages and paragraphs; for texts whose paragraphs are no longer than sizes.most."""
    trim = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    mark = r"(?i)(?:^|\n)\s*--\s*([0-9]+)\s+of\s+([0-9]+)\s*--\s*(?:\n|$)"
    plain = lambda c: rf"{trim(rf'''regexp_replace(regexp_replace(regexp_replace({c}, '[ \t]+\n', chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')''')}"
    gap = "chr(10) || chr(10)"
    end = trim(rf"regexp_replace(right(before, {sizes.overlap}), '^(?s:.*?)[.!?]\s', '')")
    words = r"string_split_regex(block, '\s+')"
    return rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, string_split_regex({plain(content)}, '{mark}') AS parts, regexp_extract_all({plain(content)}, '{mark}', 1) AS numbers FROM {source}
), u AS (
  SELECT doc_id, unnest(CASE WHEN len(numbers) = 0 THEN [{{'n': NULL::BIGINT, 'x': parts[1]}}]
    ELSE list_transform(range(1, len(numbers) + 1), lambda i: {{'n': nullif(numbers[i]::BIGINT, 0), 'x': CASE WHEN i = 1 THEN parts[1] || {gap} ELSE '' END || parts[i + 1]}}) END, recursive := true), generate_subscripts(CASE WHEN len(numbers) = 0 THEN ['x'] ELSE numbers END, 1) AS pos FROM t
), pg AS (
  SELECT doc_id, n, body, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM (SELECT doc_id, n, {plain("x")} AS body, pos FROM u) WHERE body <> ''
), mg AS (
  SELECT doc_id, 0::BIGINT AS i, []::STRUCT(f BIGINT, l BIGINT, x VARCHAR)[] AS done, false AS waiting FROM {source}
  UNION ALL
  SELECT doc_id, i, made, length(made[-1].x) < {sizes.least}
  FROM (SELECT p.doc_id, p.i, list_append(CASE WHEN waiting THEN done[:-2] ELSE done END, {{'f': CASE WHEN waiting THEN done[-1].f ELSE p.n END, 'l': p.n, 'x': CASE WHEN waiting THEN done[-1].x || {gap} ELSE '' END || p.body}}) AS made
        FROM mg JOIN pg p ON p.doc_id = mg.doc_id AND p.i = mg.i + 1)
), fin AS (
  SELECT doc_id, CASE WHEN waiting AND len(done) > 1 THEN list_append(done[:-3], {{'f': done[-2].f, 'l': done[-1].l, 'x': done[-2].x || {gap} || done[-1].x}}) ELSE done END AS done
  FROM mg QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1
), gr AS (
  SELECT doc_id, g, done[g] AS page FROM (SELECT doc_id, done, unnest(range(1, len(done) + 1)) AS g FROM fin) WHERE length(done[g].x) >= {sizes.least}
), pa AS (
  SELECT doc_id, g, block, row_number() OVER (PARTITION BY doc_id, g ORDER BY pos) AS i, length(block) <= 180 AND NOT contains(block, chr(10)) AND len({words}) <= 18 AND (
      regexp_matches(block, '(?i)^(chapter|section|part|article|appendix|annex)\s+[0-9ivxlcdm.-]+') OR regexp_matches(block, '^[0-9]+(\.[0-9]+){{0,4}}[\s.)-]+\S') OR (length(block) >= 4 AND block = upper(block) AND regexp_matches(block, '[A-Z]'))
      OR (len({words}) >= 2 AND 10 * len(list_filter({words}, lambda w: regexp_full_match(w, '[A-Z][A-Za-z0-9/&(),''-]*'))) >= 7 * len({words}) AND NOT regexp_matches(block, '[.!?]$'))) AS sec
  FROM (SELECT doc_id, g, {trim("raw")} AS block, pos FROM (SELECT doc_id, g, unnest(string_split_regex(page.x, '\n\s*\n')) AS raw, generate_subscripts(string_split_regex(page.x, '\n\s*\n'), 1) AS pos FROM gr)) WHERE block <> ''
), st AS (
  SELECT doc_id, g, 0::BIGINT AS i, '' AS held, '' AS section, '' AS before, []::STRUCT(content VARCHAR, section VARCHAR)[] AS made FROM gr
  UNION ALL
  SELECT doc_id, g, i, CASE WHEN full2 THEN section2 ELSE held2 END, section2, CASE WHEN full2 THEN e2 ELSE before2 END, CASE WHEN full2 THEN list_append(made2, {{'content': e2, 'section': section2}}) ELSE made2 END
  FROM (
    SELECT *, before2 AS before, NOT sec AND length(held2) >= {sizes.target} AS full2, CASE WHEN {end.replace("before", "before2")} = '' OR starts_with(held2, {end.replace("before", "before2")}) THEN held2 ELSE {end.replace("before", "before2")} || {gap} || held2 END AS e2
    FROM (
      SELECT doc_id, g, i, sec, CASE WHEN sec THEN regexp_replace(block, '\s+', ' ', 'g') ELSE section END AS section2, CASE WHEN full1 THEN e1 ELSE before END AS before2,
             CASE WHEN full1 THEN list_append(made, {{'content': e1, 'section': section}}) ELSE made END AS made2,
             CASE WHEN (full1 AND (sec OR section = '')) OR held = '' THEN block ELSE CASE WHEN full1 THEN section ELSE held END || {gap} || block END AS held2
      FROM (
        SELECT p.doc_id, p.g, p.i, p.block, p.sec, held, section, before, made, length(held) >= {sizes.least} AND (p.sec OR length(held) + 2 + length(p.block) > {sizes.most}) AS full1,
               CASE WHEN {end} = '' OR starts_with(held, {end}) THEN held ELSE {end} || {gap} || held END AS e1
        FROM st JOIN pa p ON p.doc_id = st.doc_id AND p.g = st.g AND p.i = st.i + 1)))
), al AS (
  SELECT doc_id, g, CASE WHEN held = '' THEN made ELSE list_append(made, {{'content': CASE WHEN {end} = '' OR starts_with(held, {end}) THEN held ELSE {end} || {gap} || held END, 'section': section}}) END AS made
  FROM st QUALIFY row_number() OVER (PARTITION BY doc_id, g ORDER BY i DESC) = 1
), ch AS (
  SELECT doc_id, g, c, made[c].content AS content, made[c].section AS section FROM (SELECT *, unnest(range(1, len(made) + 1)) AS c FROM al)
)
SELECT ch.doc_id, row_number() OVER (PARTITION BY ch.doc_id ORDER BY ch.g, c) - 1 AS chunk, content, section, page.f AS page_start, page.l AS page_end, CAST(ceil(length(content) / 4.0) AS BIGINT) AS n_tokens, length(content) AS n_chars
FROM ch JOIN gr ON gr.doc_id = ch.doc_id AND gr.g = ch.g"""


@query("win6_chunks", chunk_sql(chunking.Sizes()))
def win6(s, d):
    """Every report cut into chunks: pages, sections, sizes and overlap."""
    return chunking.chunked(view(s, d, "reports"))


_CHANGED = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Annex New' || chr(10) || chr(10) || text ELSE text END AS text FROM reports"


@query("snk1_reprocessed", chunk_sql(chunking.Sizes(), "changed").replace("WITH RECURSIVE", f"WITH RECURSIVE changed AS ({_CHANGED}),", 1))
def snk1(s, d):
    """The chunk store after all reports were processed and then every third again with a new text, every seventh with none (which fails and keeps its chunks)."""
    docs = view(s, d, "reports").select("doc_id", "text")
    path = processing.new_store(s)
    processing.reprocess(docs, path)
    again = docs.where("doc_id % 3 = 0 or doc_id % 7 = 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Annex New\n\n"), "text")).otherwise("too short"))
    processing.reprocess(again, path)
    return processing.stored(s, path)


@query("str1_job_decisions", """SELECT event_id, doc_id, CASE WHEN kind <> 'request' THEN kind WHEN row_number() OVER (PARTITION BY doc_id, ended, kind ORDER BY ts, event_id) = 1 THEN 'accepted' ELSE 'refused' END AS decision
FROM (SELECT *, count(*) FILTER (kind <> 'request') OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS ended FROM (SELECT event_id, user_id % 500 AS doc_id, ts, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'request' END AS kind FROM events))""")  # fmt: skip
def str1(s, d):
    """Requests to process a document: one active job at a time, others are refused until it has ended."""
    kind = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("request")
    return processing.decisions(table(s, d, "events").select("event_id", (F.col("user_id") % 500).alias("doc_id"), "ts", kind.alias("kind")))
