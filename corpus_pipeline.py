"""The corpus pipeline: five stages from documents to token ids.

Each stage takes (spark, docs, sf_dir), works on all that the one before has kept and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tradewind.llm import bpe, mixing, near_copies, quality, substrings
from tradewind.llm.common import configure, store

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    configure(spark)
    return quality.kept_documents(docs)


def near_copy_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id."""
    configure(spark)
    return near_copies.without_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings that occur more than once."""
    configure(spark)
    return substrings.remove_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those it does not take go."""
    configure(spark)
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and digests of these and of the decoded text."""
    configure(spark)
    return bpe.encode_documents(docs, TOKENIZER, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copy_join),
    ("suffix-array dedup", substring_dedup),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", token_ids),
]

#: SQL cannot express the outliers, the prefix-free parse, the cube method or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
