"""The corpus pipeline: from raw documents to packed token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage to the shared folder and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import bpe, mixing, ngram_join, quality, toxicity
from tallyweave.llm.queries import mixing_levels, mixing_weights
from tallyweave.session import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives 0.5 or more stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), parts=3, rest=1)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model gives less than 0.5 stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), parts=5, rest=0)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group that links by a Jaccard likeness of 0.8 of five-word shingles."""
    return ngram_join.keep_one(docs, k=5, num=80, den=100)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, by target weights; documents may repeat, up to three times."""
    return mixing.mixed(docs, mixing_levels(), mixing_weights(spark), most_epochs=3, seed=17)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the ids of each whole text, as little-endian unsigned 32-bit integers."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("ngram_jaccard", no_near_copies),
    ("mixing", mixed_sources),
    ("byte_bpe", token_ids),
]
#: The classifiers and the tokenizer can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
