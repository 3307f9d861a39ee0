"""A corpus from raw documents to packed sequences, in stages that are written and read again.

Each stage works on all that its predecessor kept, and all but the last return
the columns of the documents, whatever others there are beside ``doc_id``,
``text`` and ``lang``, and whatever their names.

Edge cases: null and empty texts fail the quality rules; a null language is a
language of its own. Of equal or near texts the one with the least id stays, so
repeated rows leave one; rows without an id go there. Very long texts pass every
stage whole. An empty table stays empty in all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prospect.llm import decontam, dedup, packing, quality, secrets
from prospect.llm.common import cut, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.keep(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, digest=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("packing", sequence_packing),
]

#: No SQL: perplexity, signatures and tokens are beyond it. tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that pass all stages."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"stage-{i + 1}")
    return docs
