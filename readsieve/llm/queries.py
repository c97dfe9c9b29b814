"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat_tools, decontam, fim, langid, lbl_lm, packing, phrases, pii, runs, simhash, tiff, url_rules
from .common import read_table

TOKENIZER = "word_bpe_49k.json"
RANKS = "byte_bpe_50k.tiktoken"


def op1_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tools.format_conversations(read_table(spark, sf_dir, "conversations"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(read_table(spark, sf_dir, "pages"))


def op4_lbl_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl_lm.score_texts(read_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.report(read_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media(read_table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(read_table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.report(read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(read_table(spark, sf_dir, "documents"))


QUERIES = (
    op1_chat_tools,
    op2_pii,
    op3_url_rules,
    op4_lbl_scoring,
    op5_decontamination,
    op6_best_fit_packing,
    op7_repeated_phrases,
    op8_language_id,
    op9_simhash_near_dedup,
    op10_tiff_media,
    op11_fill_in_middle,
    op12_byte_bpe,
    op13_periodic_runs,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_tools": chat_tools.ORACLE_SQL,
        "op2_pii": pii.ORACLE_SQL,
        "op3_url_rules": url_rules.ORACLE_SQL,
        "op7_repeated_phrases": phrases.ORACLE_SQL,
        "op11_fill_in_middle": fim.ORACLE_SQL,
        "op13_periodic_runs": runs.ORACLE_SQL,
    }
