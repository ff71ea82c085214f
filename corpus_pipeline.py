"""The corpus pipeline: each stage applies one operator to all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.llm import linededup, minhash, mixing, pieces, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression lies in the bands. Null and blank texts go; repeated rows are judged one by one."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur before, by key; emptied ones and mere copies go. Rows without a key stay."""
    return linededup.dedup(docs, n_chars="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies, the least key; of rows that repeat a key the first text. Rows without a key stay."""
    return minhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the blocks that fill the sources' quotas; a null source is one of its own. Rows without a key or a word go."""
    return mixing.keep_chosen(docs)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's sampled piece ids, which decode to its text; equal rows have equal ids."""
    return pieces.encoded(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("sentence_pieces", sentence_pieces),
]

#: zstandard, MinHash and sampled segmentation have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The piece ids of the documents that all stages keep.

    A stage takes all that the one before kept, whatever columns there are beside the key, text and
    source; an empty table gives an empty one.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
