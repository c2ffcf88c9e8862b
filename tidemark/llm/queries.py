"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tidemark.llm import bwt_dedup, centroids, chat_format, circulant_minhash, line_chunks, mixing, ngram_jaccard, quality_rules, rp_forest, sentencepiece_dropout, toxicity, turn_repair, warc
from tidemark.llm.common import cut, table


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.judge(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_dropout.segment(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_path(spark)
    warc.write(table(spark, sf_dir, "pages"), path)
    got = warc.with_referred(warc.assemble(cut(warc.read(spark, path))))
    return got.select(
        "page_id",
        F.col("capture.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.kind").alias("record_type"),
        F.col("referred_page").alias("refers_to"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.sql("SELECT -7L AS conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat_format.digest(chat_format.format_chats(turns))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.dedup(table(spark, sf_dir, "documents"))


def op9_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_chunks.report(table(spark, sf_dir, "documents"), line_chunks.PASSAGE_WORDS)
    return got.select("doc_id", "n_chunks", "n_removed", "n_removed_lines", F.length("text").cast("bigint").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turn_repair.report(turns, turn_repair.damaged(turns))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(table(spark, sf_dir, "embeddings"))


def op13_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant_minhash.link(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op4_warc": op4_warc,
    "op3_mixing": op3_mixing,
    "op5_chat_format": op5_chat_format,
    "op6_rp_forest": op6_rp_forest,
    "op7_toxicity": op7_toxicity,
    "op8_quality_rules": op8_quality_rules,
    "op9_line_chunks": op9_line_chunks,
    "op10_bwt_dedup": op10_bwt_dedup,
    "op11_turn_repair": op11_turn_repair,
    "op12_centroids": op12_centroids,
    "op13_circulant_minhash": op13_circulant_minhash,
}



def components_sql(width: int, percent: int, kept: bool) -> str:
    """Set sizes and components as DuckDB SQL: every pair of sets that share a shingle, then all that is reachable."""
    component = "CASE WHEN len(z.s) = 0 THEN z.doc_id ELSE m.component_id END"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
z AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i : i + {width} - 1], ' ')))) END AS s FROM d),
k AS (SELECT row_number() OVER () AS c, s, len(s) AS n FROM (SELECT DISTINCT s FROM z WHERE len(s) > 0)),
e AS (SELECT c, n, unnest(s) AS g FROM k),
p AS (SELECT a.c AS u, b.c AS v FROM e a JOIN e b ON a.g = b.g AND a.c < b.c AND {percent} * greatest(a.n, b.n) <= 100 * least(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
l AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
t AS (SELECT c AS a, c AS b FROM k UNION SELECT t.a, l.v FROM t JOIN l ON t.b = l.u),
i AS (SELECT k.c, min(z.doc_id) AS doc_id FROM k JOIN z ON z.s = k.s GROUP BY k.c),
m AS (SELECT k.s, o.component_id FROM k JOIN (SELECT t.a, min(i.doc_id) AS component_id FROM t JOIN i ON i.c = t.b GROUP BY t.a) o ON o.a = k.c)
SELECT z.doc_id, CAST(len(z.s) AS BIGINT) AS n_shingles, {component} AS component_id{f", (z.doc_id IS NOT DISTINCT FROM {component}) AS kept" if kept else ""}
FROM z LEFT JOIN m ON z.s = m.s
"""


ORACLES = {
    "op2_ngram_jaccard": components_sql(5, 75, False),
    "op13_circulant_minhash": components_sql(3, 85, True),
    "op12_centroids": centroids.oracle(),
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS m FROM p WHERE octet_length(encode(h)) >= 1000 GROUP BY h)
SELECT page_id, CAST(octet_length(encode(p.h)) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN g.m IS NULL OR g.m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.m <> page_id THEN g.m END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
""",
    "op5_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(text, '(<|\[)(\\*)(s>|/s>|INST\]|/INST\]|\|part\|>|\|image\|>|\|audio\|>|\|document\|>)', '\1\\\2\3', 'g') AS et,
    regexp_replace(role, '(<|\[)(\\*)(s>|/s>|INST\]|/INST\]|\|part\|>|\|image\|>|\|audio\|>|\|document\|>)', '\1\\\2\3', 'g') AS er
  FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, et)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, et) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(et) + length(er) + 20) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op8_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT k, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
tri AS (SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM p),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY k),
b AS (
  SELECT w.k, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST((SELECT count(*) - count(DISTINCT l) FROM (SELECT unnest(string_split(t, chr(10))) AS l) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov ON cov.k = w.k),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM b),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS f FROM f GROUP BY source),
m AS (SELECT sum(n) AS an, sum(f) / sum(n) AS m, CAST(count(*) AS DOUBLE) AS k, sum(n * n) AS n2, sum(f * f / n) AS q FROM h),
t AS (SELECT m, CASE WHEN an - n2 / an > 0 THEN (q - an * m * m - (k - 1) * m * (1 - m)) / (an - n2 / an) END AS tau FROM m),
pr AS (SELECT m, CASE WHEN tau > 0 THEN least(greatest(m * (1 - m) / tau - 1, 1e0), 1e4) ELSE 1e4 END AS wt FROM t),
v AS (SELECT source, (f + m * wt) / (n + wt) > 0.5 AS bad FROM h, pr)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT coalesce(bad, false)) AS kept
FROM f LEFT JOIN v ON f.source IS NOT DISTINCT FROM v.source
""",
}
