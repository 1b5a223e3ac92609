"""From raw documents to token ids: quality rules, near-duplicates, benchmark passages, secrets, encoding.

Each stage takes (spark, docs, sf_dir). All but the last return rows of documents with their columns; the last returns
their token ids. Texts that are null or empty go in the first stage; rows with a null or repeated id are judged each in
every stage but the second, where rows of one id are one document and a row without an id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meander.llm import bpe, decontaminate, near_dup, quality, secret_scan
from meander.llm.common import written
from meander.llm.queries import table, tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.good_rows(docs, tokenizer("piece_bpe_32k.model"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    found = near_dup.near_duplicates(docs, words=5, percent=80)
    return docs.join(found.where("not kept").selectExpr("id AS doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live secrets replaced."""
    return secret_scan.redact(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of each document."""
    return bpe.encode(docs, tokenizer("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("bpe", bpe_stage),
]

#: SQL can express neither the tokenisers nor the components; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
