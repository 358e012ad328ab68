"""Corpus pipeline: quality, near duplicates, repeated passages, mixture, packing.

Every stage takes the documents that the stage before it kept, as a Parquet table, and returns a DataFrame; all but the last return the columns of
documents. The stages cannot be put as SQL (a trained classifier, XXH64 fingerprints, hashes of shuffled orders, a tokenizer).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkkv.llm import packing, quality, simhash_dedup, source_mixing, substring_dedup
from sparkkv.llm._common import Scratch, released, table

STAGES = [
    ("quality classifier", quality.stage),
    ("simhash near-dedup", simhash_dedup.stage),
    ("substring dedup", substring_dedup.stage),
    ("source mixing", source_mixing.stage),
    ("best-fit packing", packing.stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result but the last is written to the shared folder and read again."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with released():
            docs = scratch.save(stage(spark, docs, sf_dir))
        scratch.drop_all_but(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
