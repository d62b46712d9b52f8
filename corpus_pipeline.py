"""A training corpus from raw documents: language, near-duplicates, personal data, mixture, sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklume.llm import language, mixing, neardup, packing, private
from tracklume.sources.tables import stored

TOKENIZER = "byte_bpe_50k.json"


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language stay; a missing label is filled in."""
    model = language.fit(docs)
    found = language.predicted(docs, model, reject=True)
    known = found.where(F.col("lang_pred") != language.UNDETERMINED)
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def with_row_keys(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a key per row: the id where it is the only row with that id, a new number below all ids elsewhere."""
    repeated = stored(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias(key)).where((F.col(key) > 1) | F.col("doc_id").isNull()).select("doc_id"), "repeated")
    if repeated.isEmpty():
        return docs.withColumn(key, F.col("doc_id"))
    least = docs.agg(F.least(F.min("doc_id"), F.lit(0))).first()[0] or 0
    alone = docs.where(F.col("doc_id").isNotNull()).join(repeated, "doc_id", "left_anti").withColumn(key, F.col("doc_id"))
    ids = repeated.select(F.col("doc_id").alias(key))
    shared = docs.join(ids, docs.doc_id.eqNullSafe(ids[key]), "left_semi")
    # stored, so that a number stays with its row
    numbered = stored(shared.withColumn(key, F.lit(least - 1) - F.monotonically_increasing_id()), "numbered")
    return alone.select(*docs.columns, key).unionByName(numbered)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: five-word shingles, similarity 0.8.

    Rows are compared, not ids: of different texts under one id, or without an id, none is lost.  A null text, or one without a word, is like no other and stays; an
    empty table stays empty.  Of equal texts the row with the smallest id stays; very long texts are compared whole.
    """
    key = next(f"row{i}" for i in range(len(docs.columns) + 1) if f"row{i}" not in docs.columns)
    keyed = with_row_keys(docs, key)
    found = neardup.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), size=5, percent=80)
    # copies are far fewer than documents: leaving them out moves less than looking the kept ones up
    copies = stored(found.where("not kept").select(F.col("doc_id").alias(key)), "copies")
    return keyed.join(copies, key, "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every identifier is replaced by its kind."""
    found = private.personal_data(docs)
    spans = F.concat("base", "added")
    hidden = found.withColumn("text", private.masked(F.col("text"), spans))
    return hidden.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics have their target shares of the tokens."""
    return mixing.sampled(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of at most 2048."""
    return packing.packed(docs, public_tokenizers.path(TOKENIZER), end_id=1, window=2048)


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_each_group),
    ("personal_data", mask_personal_data),
    ("mixing", mix_to_targets),
    ("packing", pack_sequences),
]
#: Fitted models, components and packing have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
