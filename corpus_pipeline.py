"""Corpus pipeline: the stages applied to ``documents`` in order.

Every stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor
kept; all but the last return the columns of ``documents``.

Defined results: null and empty texts are scored like others and, where kept,
are no one's near duplicate; of rows equal in doc_id and text one stays; rows
without doc_id stay only where their whole group of near duplicates has none; of a
group the smallest doc_id stays, so ties do not occur; an empty table gives an
empty result; extra columns pass through every stage but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelkit.llm import bpe_codec, decontaminate, ngram_join, quality, substrings
from panelkit.llm.store import stored
from panelkit.sources.tables import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier, fitted on the labelled ones, rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return ngram_join.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that recur are cut out; documents left without words go."""
    return substrings.remove(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def codec_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode every text; the digests of both are the pipeline's result."""
    return bpe_codec.digests(docs)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("substrings", substring_stage),
          ("decontamination", decontamination_stage), ("bpe_codec", codec_stage)]

#: A fitted classifier and a tokenizer are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
