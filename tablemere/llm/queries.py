"""The training-data queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemere.llm import bpe, langid, mixing, quality, rules, secrets, simhash, toxicity, urls, vectors
from tablemere.llm.common import crc_mod, read_table

#: Where the tokenizers file is, on the driver.
TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.json"))

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def _classified(docs: DataFrame, modulus: int, rest: int, scored, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) with ``scored`` of documents keyed by id and held_out."""
    marked = docs.select(F.struct("doc_id", (crc_mod("doc_id", modulus) == rest).alias("held_out")).alias("key"), "text")
    return scored(marked).select("key.*", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    forest = quality.fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    return _classified(docs, 5, 0, lambda d: quality.score(d, forest, "key"), 0.3)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read_table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"), urls.QUERY_RULES)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(read_table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    return _classified(docs, 5, 0, lambda d: toxicity.score(d, model, "key"), 0.5)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    model = langid.fit(docs.where(~held_out))
    marked = docs.select(F.struct("doc_id", held_out.alias("held_out")).alias("key"), "text")
    return langid.predict(marked, model, "key").select("key.*", "lang_pred", "score")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": rules.ORACLE_SQL, "op4_url_filters": urls.ORACLE_SQL, "op9_vectors": vectors.ORACLE_SQL}
