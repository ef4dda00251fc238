"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import alignment, bpe, chat, collocations, media, mixing, pages, quality, rules, sharding, simhash, tokencounts, tokenfiles
from factloom.llm.shared import table, word_count, write_shared


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = write_shared(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    mixed = mixing.with_copies(sized, mixing.plan(sized), F.col("size"))
    return mixed.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("size")).alias("taken"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_texts(table(spark, sf_dir, "pages"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    done = chat.format_conversations(rows).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("mask")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, _ = quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "score", "gumbel", "kept")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = tokenfiles.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfiles.read_documents(written)


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.verdicts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), texts=False)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_html": op2_html,
    "op3_chat": op3_chat,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_media": op6_media,
    "op7_token_files": op7_token_files,
    "op8_rules": op8_rules,
    "op9_simhash": op9_simhash,
    "op10_bpe": op10_bpe,
    "op11_collocations": op11_collocations,
    "op12_token_counts": op12_token_counts,
    "op13_alignment": op13_alignment,
    "pipeline": pipeline,
}

_OP1 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST(('0x' || substr(md5('pareto|17|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1]::DOUBLE AS weight FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(2.0::DOUBLE * sum(source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW r AS (ORDER BY 2.0::DOUBLE * source_size / weight, source ASC NULLS LAST)
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, max(level) OVER () * weight) AS target FROM l
), c AS (
  SELECT source, g, words, source_size, target,
         (target - 2.0::DOUBLE * coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / nullif(CAST(sum(words * g) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE), 0) AS level
  FROM (SELECT source, greatest(64 - 3 * (CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END), 1) AS g, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY ALL) x
       JOIN t USING (source) WINDOW o AS (PARTITION BY source ORDER BY g DESC)
), v AS (
  SELECT source, max(level) AS level FROM c GROUP BY source
), e AS (
  SELECT d.doc_id, d.source, d.size, d.u, t.source_size, t.target,
         CASE WHEN t.source_size = 0 THEN 0.0 WHEN t.target >= 2.0::DOUBLE * t.source_size THEN 2.0
              ELSE least(2.0::DOUBLE, v.level * greatest(64 - 3 * (CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END), 1)) END::DOUBLE AS copies
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN v ON d.source IS NOT DISTINCT FROM v.source
), p AS (
  SELECT *, floor(copies) AS whole, copies - floor(copies) AS p, target - sum(floor(copies) * size) OVER (PARTITION BY source) AS rest, (u + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS a FROM e
), r AS (
  SELECT *, CASE WHEN p > 0 THEN a / (1.0::DOUBLE - a) / (p / (1.0::DOUBLE - p)) END AS ratio FROM p
), n AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY ratio NULLS LAST, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM r
)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN ratio IS NOT NULL AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM n
"""

_OP3 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, length(regexp_replace(text, '(\\*)(<s>|</s>|\[/?(?:SYS|INST|OUT|MSG)\])', '\\\1\2', 'g'))
            + CASE role WHEN 'system' THEN 14 WHEN 'user' THEN 16 ELSE 14 END AS chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(chars) + 8 AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

_OP11 = r"""
WITH w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), s AS (
  SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)) GROUP BY ALL HAVING count(*) >= 30
), c AS (
  SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS ws FROM g WHERE k > 1
), t AS (
  SELECT c.lang, c.phrase, c.a, j, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * c.a) // (l.f + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:j], ' ') JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[j + 1:], ' ')
), b AS (
  SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), i AS (
  SELECT lang, array_to_string(ws[x:x + y - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - y + 2)) AS x FROM (SELECT *, unnest(range(2, k)) AS y FROM c)) GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM b JOIN s ON s.lang = b.lang LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 80 * a QUALIFY rank <= 2000
"""

ORACLE_SQL = {"op1_mixing": _OP1, "op3_chat": _OP3, "op11_collocations": _OP11}
