"""From documents to packed training batches, in five stages of the training-data operators.

Part of the training-data subpackage. Each stage takes (spark, docs, sf_dir) and works on
all that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.exact_dedup import exact_dedup
from millrace.llm.jaccard_join import near_dedup
from millrace.llm.mixing import mix
from millrace.llm.packing import pack, stored_order
from millrace.llm.quality import quality_filter
from millrace.llm.shared import Shelf, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays."""
    return near_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is read once at least, those of small sources more often; rows stand in the order of the mix."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences with their length bucket, batch and place in the batch; batches are filled in the order of the mix, as its files hold it."""
    return pack(docs, order=stored_order())


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixture), ("packing", packing)]

#: The classifier, the bisection and the dynamic programming have no SQL; tests hold each stage of a run, and run() itself, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shelf, docs = Shelf(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shelf.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
