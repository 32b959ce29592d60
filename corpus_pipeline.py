"""From raw documents to packed training sequences: five stages, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import lines, minhash, mixing, packing, quality
from docloom.llm.common import Scratch, table
from docloom.llm.queries import tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, in docs' columns; nulls, empty and long texts, repeats, ties and clashing names as in quality.accepted."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines, in docs' columns; the rest as in lines.cleaned."""
    return lines.cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, in docs' columns; the rest as in minhash.first_of_each."""
    return minhash.first_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's runs of words as documents, in docs' columns; the rest as in mixing.mixed_documents."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents with their ids; the rest as in packing.pack."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True)


STAGES = [("quality", quality_filter), ("lines", line_dedup), ("near_dedup", near_dedup), ("mixing", source_mix), ("packing", pack)]

ORACLE_SQL = None  # a learnt score, tokens and pseudorandom draws: not for SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of documents after all stages; the tables between them are kept in the shared folder until the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
