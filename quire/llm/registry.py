"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.tool_calls import linked_tool_calls

    return linked_tool_calls(table(spark, sf_dir, "conversations"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.language_id import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.token_files import token_files

    return token_files(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"), width=2)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op9_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.sentencepieces import piece_digests

    return piece_digests(table(spark, sf_dir, "documents"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.nearest import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    import corpus_pipeline

    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return found | {"pipeline": corpus_pipeline.run}


ORACLE = {}

ORACLE["op1_exact_dedup"] = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

ORACLE["op2_tool_calls"] = r"""
WITH c AS (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN 'respond' ELSE 'configure' END AS name, text, md5(conv_id || ':' || turn) AS call_id,
    dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS level
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'system'))),
r AS (
  SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY text IS NULL, text) AS n
  FROM (SELECT DISTINCT conv_id, turn, text, md5(conv_id || ':' || (turn - 1)) AS call_id FROM conversations WHERE role = 'assistant')),
j AS (
  SELECT c.conv_id, c.call_id, c.turn, c.level, c.name, r.call_id IS NOT NULL AS linked,
    CASE WHEN c.text IS NULL THEN 'text: missing'
      WHEN c.name = 'respond' AND length(c.text) > 1000000 OR c.name = 'configure' AND length(c.text) > 100000 THEN 'text: too long'
      WHEN c.turn < 0 THEN 'turn: negative' END AS error,
    c.text AS ctext, r.text AS rtext
  FROM c LEFT JOIN r ON c.call_id = r.call_id AND r.n = 1)
SELECT conv_id, call_id, turn, level, name, linked, error,
  '{' || concat_ws(',',
    '"arguments":{' || concat_ws(',', '"text":' || CAST(to_json(ctext) AS VARCHAR), '"turn":' || turn) || '}',
    '"id":"' || call_id || '"', '"name":"' || name || '"',
    CASE WHEN linked THEN '"result":' || coalesce(CAST(to_json(rtext) AS VARCHAR), 'null') END, '"valid":' || (error IS NULL)) || '}' AS json
FROM j
UNION ALL
SELECT conv_id, call_id, turn, NULL, NULL, true, CASE WHEN call_id IN (SELECT call_id FROM c) THEN 'another result of a call' ELSE 'result without a call' END,
  '{"id":"' || call_id || '","result":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || '}'
FROM r WHERE n > 1 OR call_id NOT IN (SELECT call_id FROM c)
"""

ORACLE["op8_source_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '|' || md5(coalesce(text, '')))), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS cap FROM s0),
s2 AS (
  SELECT *, cap / w AS ratio,
    (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM s1 WINDOW b AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, max(CASE WHEN ratio > level THEN level END) OVER () AS flat FROM s2),
s4 AS (SELECT source, source_size, CASE WHEN ratio <= level THEN cap ELSE w * flat END AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS copies FROM s4),
s6 AS (SELECT *, floor(copies) AS whole, copies - floor(copies) AS p, target - floor(copies) * source_size AS rest FROM s5),
j AS (
  SELECT d.*, source_size, target, whole, rest,
    CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q
  FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
r AS (SELECT *, CASE WHEN q IS NOT NULL THEN sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) END AS upto FROM j),
g AS (SELECT source, max(rest) - coalesce(max(CASE WHEN upto <= rest THEN upto END), 0) AS gap FROM r GROUP BY source),
f AS (
  SELECT source, arg_min(doc_id, struct_pack(m := abs(size - gap), q := q, i := doc_id)) AS fit
  FROM r JOIN g USING (source) WHERE upto > rest AND gap > 0 AND abs(size - gap) < gap GROUP BY source)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN q IS NOT NULL AND (upto <= rest OR doc_id = fit) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r LEFT JOIN f USING (source)
"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
