"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that calls one of
the operators in ``marketlens.llm``.  Its result is written as Parquet and read
again as the next stage's ``docs``; all but the last return the columns of
``documents``.

1. quality: documents that the ordinal classifier rejects go.
2. near_dedup: one document of each group of near-duplicates (shingles of five
   words, similarity 0.8 or more) stays.
3. decontaminate: documents with too much of a benchmark item go.
4. secrets: secrets in the texts are replaced by a mark; no document goes.
5. pack: the documents are cut into pieces that fill token sequences.

Nulls, empty texts, repeated rows, empty tables and further columns are handled
as each operator's docstring says; an empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketlens.llm import decontam, minhash, packing, quality, secrets
from marketlens.llm.shared import cut, table


def rate_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accept_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs, k=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality", rate_quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", hide_secrets), ("pack", pack)]

# A trained classifier and a tokenizer have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
