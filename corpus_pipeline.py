"""From raw documents to token files: quality, near duplicates, benchmark passages, source mix, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is written before the next one reads it.
All but the last return the columns of ``documents``, others that a table has among them.

In every stage null and empty texts are alike (no words, no ids but the end id), texts of any length are read whole, rows without an id or with a repeated
one are judged by their own texts, and an empty table gives an empty one. tests/llm/test_pipeline.py runs each stage on such rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timberline.llm import decontaminate, importance, mixing, simhash, token_output
from timberline.llm.common import saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the importance sample: about as many documents as look like those labelled good.

    Null and empty texts weigh nothing, and are in or out by their noise. Ties at the sample's edge are all in. Repeated rows have the same weight, those that share an id the same noise.
    """
    return importance.sampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops a document if one before it stays whose runs of five words are like its own: a Jaccard similarity of 0.8 or more.

    Candidates come from fingerprints of word pairs at most 6 bits apart and from MinHash bands of five words; the sets of runs
    decide. Of document pairs of 0.8 or more, fingerprints of five words are 10 bits apart (median), too far for any band to agree; those of word pairs are 5.

    Null and empty texts are one text. Of repeated rows one stays, the one of the smallest id, and a row without an id only where no other has one.
    """
    return simhash.keep_one(docs, shingle=2, radius=6)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten words in a row of a benchmark item, or a whole shorter item. Null and empty texts hold none; repeated rows stay or go together."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or thins out whole documents so that sources come near their targets. Null sources are one source; rows of equal size stand by id, then by text."""
    return mixing.emitted(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files and returns what they hold of each document. Null ids come first; rows that repeat an id follow each other."""
    return token_output.tokens(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("token_files", token_files)]

#: Hashes, shifts and tokenisers have no SQL: tests hold the pipeline against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
