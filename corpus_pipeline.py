"""Corpus pipeline: quality rules, near-duplicates, secrets, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``, whatever else these are. Null and empty
texts, repeated rows and empty tables have the results that the operators'
docstrings give: texts without ten words go in the first stage. ``run`` stores each stage's output as a
table in the cluster's shared folder and gives it to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemere.llm import bpe, mixing, rules, secrets, shingles
from tablemere.llm.common import read_table, remove, stored, whole_row
from tablemere.llm.queries import TOKENIZER


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    Null and empty texts have no word and go; very long texts are measured
    whole; repeated rows get one verdict; an empty table stays empty; other
    columns pass through.
    """
    return rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by five-word shingles of Jaccard similarity 0.8 or more: the one with the least id.

    SimHash and its popcount grid find the nearest, a prefix filter the rest;
    all are compared exactly. Null and empty texts are one group; shorter texts are one shingle; very
    long texts are compared whole; of rows with one id one stays (which, if
    their texts differ, is not defined); rows without id stay, for none can
    name a group; an empty table stays empty; other columns pass through.
    """
    return shingles.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``[SECRET]`` for each stretch under found secrets, and n_chars to match.

    Null texts stay null; very long texts are scanned whole; overlapping and
    touching stretches are one; repeated rows are changed alike; an empty table
    stays empty; other columns pass through.
    """
    found = secrets.scan(docs.select(whole_row(docs, but=("text",)).alias("row"), "text"), "row", redact=True)
    now = {"text": F.col("clean"), "n_chars": F.when(F.size("spans") > 0, F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*[now[c].alias(c) if c in now else F.col("row").getField(c).alias(c) for c in docs.columns])


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of some sources more often, to the target weights.

    Null sources are one source; null and empty texts weigh nothing and come
    once; a very long text is one document; rows at one place of the permutation
    stand in no order; repeated rows count each; an empty table stays empty;
    other columns pass through.
    """
    return mixing.mix(docs, budget=None, carry=True)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, and whether decoding them gives its text.

    Each different text is encoded once, however often mixing repeats it. Null
    and empty texts have no ids; very long texts are encoded whole; repeated
    rows give repeated rows; an empty table gives none; columns but doc_id, lang
    and source are not read.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(body.alias("text")).distinct().select(F.sha2("text", 256).alias("key"), "text")
    ids = bpe.encode(texts, TOKENIZER, "key")
    keys = docs.select("doc_id", "lang", "source", F.sha2(body, 256).alias("key"))
    made = keys.join(ids, "key")
    return made.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "intact")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mixing_weights", mixing_weights),
    ("token_ids", token_ids),
]

#: SQL can't express fingerprint components, decoding worklists or byte-pair merges; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``; the last is left lazy."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), name)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
