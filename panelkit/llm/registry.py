"""Queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import (bpe_codec, decontaminate, lexical, line_rules, ngram_join, oracles, periodic, pq, quality, shards,
                          substrings, token_counts, token_files, tool_calls)
from panelkit.llm.store import scratch
from panelkit.sources.tables import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removals(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path)
    return token_files.read_token_files(spark, path)


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.from_conversations(table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(tool_calls.SCHEMAS, "name string, field string, type string, required boolean")
    return tool_calls.link(calls, results, schemas).withColumn("errors", F.array_join("errors", ","))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(table(spark, sf_dir, "documents"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_plan(table(spark, sf_dir, "documents"), shards=40)


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(table(spark, sf_dir, "documents"))


def op11_term_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.plant(table(spark, sf_dir, "documents")))


def op13_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_substrings, op3_token_files, op4_winnowing, op5_token_counts,
                                   op6_tool_calls, op7_quality, op8_bpe_codec, op9_shards, op10_line_rules,
                                   op11_term_pipeline, op12_periodic_runs, op13_pq_dedup)}
#: the others hold a tokenizer, a fitted model or a packing, which SQL does not express; tests use brute force
SQL: dict[str, str] = {"op1_ngram_join": oracles.OP1, "op2_substrings": oracles.OP2, "op4_winnowing": oracles.OP4,
                       "op6_tool_calls": oracles.OP6, "op10_line_rules": oracles.OP10,
                       "op11_term_pipeline": oracles.OP11}
