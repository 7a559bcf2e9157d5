"""The corpus pipeline: quality rules, near-duplicate removal, secret scans,
mixing and tokenisation, each stage written as Parquet and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from connlearn.llm import bpe, mixing, quality, secrets, simhash
from connlearn.llm.common import read, staged

#: (name, function of (spark, docs, sf_dir)); all but the last return the
#: columns of documents.
STAGES = [
    ("quality_rules", quality.stage),
    ("simhash_near_dedup", simhash.stage),
    ("secret_scan", secrets.stage),
    ("source_mixing", mixing.stage),
    ("byte_bpe", bpe.stage),
]

#: SimHash, regular-expression spans and BPE are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``, in order."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
