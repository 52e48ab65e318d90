"""The operators as queries over the whole tables, with production parameters."""

from collections.abc import Callable

import corpus_pipeline
from corpus_pipeline import TOKENIZER
from pyspark.sql import DataFrame, SparkSession

from tradewind.llm import (
    bpe,
    chats,
    collocations,
    contamination,
    fingerprints,
    mixing,
    near_copies,
    quality,
    search,
    sharding,
    substrings,
    token_counts,
    url_filters,
)
from tradewind.llm.common import configure


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def op1_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return quality.judge(docs)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return token_counts.count_tokens(docs, TOKENIZER)


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return sharding.shard(docs, 40)


def op4_url_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages", "page_id", "url", "html")
    return url_filters.judge(pages)


def op5_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.encode_documents(docs, TOKENIZER).drop("text")


def op6_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "source")
    columns = ("doc_id", "size", "source_size", "target", "taken")
    return mixing.mix(docs).select(*columns)


def op7_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_report(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op9_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovered turns of transcripts written from the conversations, all of which train."""
    turns = _read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    transcripts = chats.raw_transcripts(turns)
    model = chats.train(transcripts, "conv_id", "turn", "role", "raw")
    return chats.parse(transcripts, model)


def op10_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op11_best_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return search.rank(docs, _read(spark, sf_dir, "benchmark", "item_id", "text"))


def op12_son_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_read(spark, sf_dir, "documents", "text", "lang"))


def op13_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    items = _read(spark, sf_dir, "benchmark", "item_id", "text")
    return contamination.report(contamination.find_items(docs, items))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_outliers,
        op2_token_counts,
        op3_kd_shards,
        op4_url_segmentation,
        op5_bpe_pair_index,
        op6_cube_mix,
        op7_chosen_path_join,
        op8_prefix_free_parsing,
        op9_transcripts,
        op10_quartile_digest,
        op11_best_positions,
        op12_son_collocations,
        op13_wu_manber,
    )
} | {"pipeline": corpus_pipeline.run}
