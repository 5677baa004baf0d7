"""The registered queries: each applies one operator to its whole table and derives the columns that are compared."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearwright.llm import bloom_search, bpe, byte_bpe, decontaminate, embeddings, laesa, pii, quality, sharding, simhash, token_counts, toxicity, warc
from clearwright.llm.common import held_out, labelled_sample, shared_folder, table

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


OP1_SQL = r"""
WITH responses AS (
  SELECT md5(concat_ws('|', coalesce(CAST(page_id AS VARCHAR), ''), coalesce(url, ''), 'response')) AS h, coalesce(url, '') AS target_uri, coalesce(html, '') AS html
  FROM pages),
named AS (
  SELECT '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS refers_to, target_uri, html,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) AS source_headers
  FROM responses),
plain AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '[	

 ]+', ' ', 'g'),
      '<(br|/p|/li|/h[1-6]|/div|/title|/tr)[^>]*>', chr(10), 'gi'), '<[^>]*>', ' ', 'g') AS bare,
    trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')) AS title,
    regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1, 'i') AS language,
    regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1, 'i') AS links
  FROM named),
blocks AS (
  SELECT refers_to, target_uri, source_headers, html, 'conversion' AS record_type, 'text/plain; charset=utf-8' AS content_type,
    regexp_replace(regexp_replace(regexp_replace(RESOLVED(bare), ' +', ' ', 'g'), ' ?
[
 ]*', chr(10), 'g'), '^[
 ]+|[
 ]+$', '', 'g') AS block
  FROM plain
  UNION ALL
  SELECT refers_to, target_uri, source_headers, html, 'metadata', 'application/warc-fields',
    'title: ' || trim(RESOLVED(title)) || chr(13) || chr(10) || 'language: ' || language || chr(13) || chr(10)
      || coalesce(array_to_string([('outlink: ' || RESOLVED(u) || chr(13) || chr(10)) FOR u IN links], ''), '')
  FROM plain),
ids AS (SELECT *, md5(refers_to || '|' || record_type) AS h FROM blocks)
SELECT '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS record_id, record_type, refers_to, target_uri,
  '2024-01-01T00:00:00Z' AS date, content_type, source_headers, 'sha256:' || sha256(html) AS source_digest,
  'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length, block
FROM ids
"""


def _resolved_sql(sql: str) -> str:
    """RESOLVED(x) as nested replacements of the references that the pages hold, some cut short of their semicolon; the ampersand last."""
    for name in ("bare", "title", "u"):
        text = name
        for reference, code in (("lt", 60), ("gt", 62), ("quot", 34), ("apos", 39), ("#39", 39), ("nbsp", 32), ("copy", 169), ("middot", 183), ("amp", 38)):
            text = f"regexp_replace({text}, '&{reference};?', chr({code}), 'g')"
        sql = sql.replace(f"RESOLVED({name})", text)
    return sql


@query("op1_warc_derivatives", _resolved_sql(OP1_SQL))
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return warc.derivatives(warc.responses_of_pages(table(spark, folder, "pages")))


@query("op2_simhash_near_duplicates")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def _scored(scores: DataFrame, limit: float) -> DataFrame:
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


@query("op3_toxic_passages")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.train(labelled_sample(docs, table(spark, folder, "labels"), "toxic", toxicity.SAMPLE))
    return _scored(toxicity.score(docs, model), 0.5)


@query("op4_token_counts")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    cache = shared_folder(spark, "token-counts")
    return token_counts.count_tokens(table(spark, folder, "documents"), cache, public_tokenizers.path("piece_bpe_32k.model"))


@query("op5_bpe_round_trip")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.encode_and_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_quality_scores")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.train(labelled_sample(docs, table(spark, folder, "labels"), "quality", quality.SAMPLE))
    return _scored(quality.score(docs.select("doc_id", "text"), model), 0.3)


@query("op7_benchmark_contamination")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.size("near_items").cast("long").alias("n_near_items"))


@query("op8_personal_data")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.all_spans(table(spark, folder, "documents"))
    return found.select("doc_id", *(pii.count_of(k).alias(f"n_{k}") for k in pii.KINDS), F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.every_span_text().alias("spans"))


@query("op9_embedding_near_duplicates")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


@query("op10_interleaved_shards")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.interleave(table(spark, folder, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op13_byte_bpe_round_trip")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = byte_bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return coded.select("doc_id", byte_bpe.n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _clusters_sql(centroids: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, scale: int = 1024) -> str:
    """The rounds one after the other as materialised steps."""
    squared = "CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.x, c.x)]) AS BIGINT)"
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(CAST(a AS DOUBLE) * {scale}) AS BIGINT) FOR a IN embedding] AS x
  FROM embeddings WHERE len(embedding) = {dim} AND len([a FOR a IN embedding IF a IS NOT NULL AND isfinite(a)]) = {dim})""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS c, x
  FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {centroids}))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT rid, any_value(vec_id) AS vec_id, any_value(x) AS x, min({{'d': d, 'c': c}}) AS best
  FROM (SELECT v.rid, v.vec_id, v.x, c.c, {squared} AS d FROM v, c{r} c) GROUP BY rid)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c{r}.c, coalesce(m.x, c{r}.x) AS x
  FROM c{r} LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS x
    FROM (SELECT best.c AS c, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, {dim + 1}) AS t(j) GROUP BY ALL) GROUP BY c) m ON m.c = c{r}.c)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, CAST(a.best.c AS INTEGER) AS cluster, a.best.d AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.best.c
"""


@query("op12_laesa_clusters", _clusters_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    placed = laesa.cluster(table(spark, folder, "embeddings"))
    return placed.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


OP11_SQL = r"""
WITH words AS (
  SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
tf AS (SELECT rid, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM words GROUP BY rid, term),
sizes AS (SELECT rid, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY rid),
total AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(documents) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
items AS (
  SELECT iid, any_value(item_id) AS item_id, term, count(*) AS times
  FROM (SELECT iid, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT row_number() OVER () AS iid, item_id, text FROM benchmark))
  GROUP BY iid, term),
scored AS (
  SELECT iid, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id,
    CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * documents) // terms)))) AS BIGINT) AS score
  FROM items JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (rid), total GROUP BY iid, rid),
ranked AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query("op11_bloom_search", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return bloom_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
