"""The corpus pipeline: each stage takes all documents that the one before has kept.

1. Documents whose language is not known go; without labels to learn from, only those without letters.
   How sure the model must be follows the number of labels.
2. Of each group of near-duplicates one document stays.
3. Documents that hold a benchmark item go.
4. Personal data in the texts is replaced by its kind.
5. What is left is packed into sequences.

All stages but the last return the columns of documents, and their results are written as Parquet
to the shared folder and read again.  No SQL expresses the whole; the stages are tested against
brute force.

Edge cases: null and empty texts, and such without letters, go in the first stage; a null doc_id is
kept, and comes last where one of a group stays; repeated rows are one group, of which one stays; ties go to
the smallest doc_id, then to the first row; very long texts are read whole; a null lang is not learned
from; an empty table gives an empty result, and an empty benchmark takes nothing away; more columns
pass all stages but the last unchanged, whatever their names, but for n_chars, which follows the redacted text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readsieve.llm import decontam, langid, packing, pii, simhash
from readsieve.llm.common import read_table
from readsieve.storage import Workspace

TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    redacted = pii.redact(docs)
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return redacted


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep."""
    work = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        docs = work.save(docs) if k < len(STAGES) else docs
    return docs
