"""From raw documents to packed training sequences, as stages that are written and read again.

A stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxloom.llm import mixing, packing, pii, quality, similar
from voxloom.llm.common import Scratch


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, model).where("voxloom_quality.kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that are linked by a similarity of 0.8 or more in shingles of five words one stays."""
    return similar.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data in its text is replaced by the name of its kind."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; those of small sources are repeated, up to twice, towards flatter weights."""
    return mixing.mix_sources(docs, mixing.Plan(max_repeats=2.0, budget="cover")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the permitted lengths, as lists of documents' pieces."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", rules), ("near duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mix), ("packing", pack)]

#: Fingerprints, trees and packing have no SQL form; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    last = None
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last:  # the stage has read it for the last time
            scratch.drop(last)
        last = name.replace(" ", "-")
    return STAGES[-1][1](spark, docs, sf_dir)
