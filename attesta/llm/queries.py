"""The queries that apply each operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attesta.llm import ann, licences, linededup, minhash, mixing, pieces, quality, quotes, sharding, toxicity
from attesta.llm.common import read


def op1_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"))


def op2_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(read(spark, sf_dir, "documents"))


def op3_toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that pass, with their ratios."""
    return quality.score(read(spark, sf_dir, "documents")).where("reason = 'ok'")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that goes, with the one of its group that stays."""
    return minhash.duplicates(read(spark, sf_dir, "documents"))


def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without the chunks that occur before."""
    return linededup.dedup(read(spark, sf_dir, "documents"), n_chars="n_chars")


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.choose(read(spark, sf_dir, "documents"))


def op9_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op10_quoted_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.threads(read(spark, sf_dir, "conversations"))


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threads of the same conversations with quotations put into them by rule; ``conversations`` itself has none."""
    return quotes.threads(quotes.with_quotations(read(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_nearest_vectors, op2_sampled_pieces, op3_toxic_documents, op4_quality_bands, op5_near_duplicates,
        op6_line_chunks, op7_licences, op8_source_mix, op9_slot_shards, op10_quoted_threads, quoted_conversations,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_source_mix": mixing.sql(), "op10_quoted_threads": quotes.sql(), "quoted_conversations": quotes.sql(quotes.with_quotations_sql())}
