"""The registered queries of the numbered operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklume.llm import fingerprint, language, licenses, mixing, nearest, negatives, neardup, packing, passages, private, quality, token_files, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = "byte_bpe_50k.json"


def registered(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@registered("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_notices(documents(spark, sf_dir))


_OP2_SQL = r"""
WITH RECURSIVE marked AS (
  SELECT doc_id, source, lang, coalesce(source, '(none)') AS s, coalesce(lang, '(none)') AS l,
    CASE WHEN contains(t, 'License') OR contains(t, 'Licensed') THEN 'legal' WHEN contains(t, ' | ') THEN 'tabular'
         WHEN length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) >= 20 THEN 'numeric' ELSE 'prose' END AS topic,
    greatest(len(regexp_extract_all(t, '[^\x09-\x0D\x20]+')), 1) AS tokens
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)
),
cells AS (SELECT s, l, topic, CAST(sum(tokens) AS DOUBLE) AS n FROM marked GROUP BY ALL),
gs AS (SELECT s, sum(n) ^ 0.8 / sum(sum(n) ^ 0.8) OVER () AS g FROM cells GROUP BY s),
gl AS (SELECT l, sum(n) ^ 0.8 / sum(sum(n) ^ 0.8) OVER () AS g FROM cells GROUP BY l),
gt AS (SELECT topic, sum(n) ^ 0.8 / sum(sum(n) ^ 0.8) OVER () AS g FROM cells GROUP BY topic),
fit AS (
  SELECT 0 AS i, s, l, topic, n, gs.g AS g1, gl.g AS g2, gt.g AS g3, n AS w FROM cells JOIN gs USING (s) JOIN gl USING (l) JOIN gt USING (topic)
  UNION ALL
  SELECT i, s, l, topic, n, g1, g2, g3, w * g3 / sum(w) OVER (PARTITION BY topic) FROM (
    SELECT * REPLACE (w * g2 / sum(w) OVER (PARTITION BY l) AS w) FROM (
      SELECT i + 1 AS i, s, l, topic, n, g1, g2, g3, w * g1 / sum(w) OVER (PARTITION BY s) AS w FROM fit WHERE i < 80))
),
rates AS (SELECT s, l, topic, (w / n) / max(w / n) OVER () AS p FROM fit WHERE i = 80)
SELECT doc_id, source, lang, topic, CAST(tokens AS BIGINT) AS tokens, round(p, 6) AS probability
FROM marked JOIN rates USING (s, l, topic)
WHERE CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 < p
"""


@registered("op2_mixing", _OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    picked = mixing.sampled(docs)
    return picked.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"))


@registered("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), end_id=0)
    return token_files.read_token_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@registered("op4_order_minhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


@registered("op5_hyperminhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), size=4, percent=80)


@registered("op6_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the documents whose hash remainder is not 2, predicts all."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = documents(spark, sf_dir).withColumn("held_out", held_out)
    model = language.fit(docs.where(~F.col("held_out")))
    return language.predicted(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


@registered("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


_OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.c, d.c) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.c) = len(d.c) WHERE q.vec_id % 50 = 0
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@registered("op8_kd_tree", _OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5, scale=256)


@registered("op9_difference_cover")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.without_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@registered("op10_bootstrapped_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private.personal_data(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [F.size(F.filter("base", private.is_kind(kind))).cast("long").alias(f"n_{kind}") for kind in private.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(private.listed(F.col("base")), 256).alias("base_sha256"), private.listed(F.concat("base", "added")).alias("spans")
    )


_OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.c, b.c) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.c) = len(b.c) WHERE a.vec_id % 50 = 0
),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5
),
n AS (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


@registered("op11_hard_negatives", _OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh id has its label moved on by one first: wrong labels that the search has to live with."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", moved)
    return negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


@registered("op12_quality")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labels whose hash remainder is not 2, scores all documents."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", held_out)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.fit(docs.where(~F.col("held_out")), labels)
    return quality.scored(docs, model).select("doc_id", "held_out", "score", "predicted")


@registered("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=4, scale=256)
