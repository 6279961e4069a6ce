"""Corpus preparation: documents in, packed training sequences out.

``STAGES`` names the stages in order. Each takes ``(spark, docs, sf_dir)`` and
returns a frame; it is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``docs`` as they came, extra ones
included. ``run`` applies them to the documents table.

Defined results: a null or empty text is not toxic, but fails the word count of
the quality rules; an empty table passes every stage and packs to nothing; rows
that repeat an id are judged by their own texts, and those that also have the same
n-grams are one document after the Jaccard stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, jaccard_join, packing, quality_rules, toxicity
from tessera.session import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below one half."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands."""
    return quality_rules.keep_clean(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of linked documents."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands: one quoted item in a long document is enough to go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their token ids."""
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), str(n))
        if n:
            scratch.drop(str(n - 1))
    return docs


#: A learned model and zstandard ratios are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None
