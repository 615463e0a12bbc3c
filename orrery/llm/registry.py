"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import chat, chunks, decontaminate, langid, mixing, quality, secrets, simhash, tokens, topk, twins
from orrery.llm.common import prepare, table


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.read_back(chat.format_turns(rows.unionByName(extra)))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_to_files(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeats(table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable]:
    def prepared(query: Callable) -> Callable:
        @functools.wraps(query)
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(prepare(spark), sf_dir)

        return call

    found = (op1_langid, op2_chunks, op3_topk, op4_mixing, op5_secrets, op6_chat, op7_decontaminate, op8_tokens, op9_quality, op10_simhash)
    return {f.__name__: prepared(f) for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": twins.TOPK, "op5_secrets": twins.SECRETS, "op6_chat": twins.CHAT}
