"""Corpus pipeline: the documents table through the operators, stage by stage."""

from __future__ import annotations

from ordersight.llm import langid, mixing, packing, secret_scan, simhash_dedup
from ordersight.llm.common import scratch_path, table

STAGES = [
    ("language_id", langid.stage),
    ("simhash_dedup", simhash_dedup.stage),
    ("secret_scan", secret_scan.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: Trained models, XXH64 and a tokenizer have no SQL form; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages applied to documents, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
