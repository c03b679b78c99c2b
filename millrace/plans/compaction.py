"""Postings in two tiers: a base table bucketed by fingerprint, and the batches stored since.

A read folds the batches and joins them to the base; a compaction stores that as the next
base. Both shuffle the batches only: the base lies in the buckets of the join key, so it is
neither moved nor folded again, however long the history is.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.identity import ENRICHED, fold
from ..operators.sinks import store_postings
from ..stored import removed, table_at

BUCKETS = 64


class PostingTable:
    """Postings under a folder: batches/batch=<n>, and bases base=<k> that hold all batches below their number.

    Bases are tables of the session's catalog over files in the folder, as only those keep
    their buckets; a new session names them again from the folder.
    """

    def __init__(self, spark: SparkSession, target: str, buckets: int = BUCKETS):
        self.spark, self.target, self.buckets = spark, target.rstrip("/"), buckets
        self.name = f"postings_{hashlib.sha256(self.target.encode()).hexdigest()[:24]}"

    def add(self, sightings: DataFrame, number: int) -> None:
        """Stores a batch of accepted sightings, folded; a repeated batch replaces itself. Numbers below that of the base are in it and can't be written again."""
        if number < self.covered():
            raise ValueError(f"batch {number} is in the base already")
        store_postings(sightings, f"{self.target}/batches", number)

    def covered(self) -> int:
        """The number of the newest base: all batches below it are in it; 0 without a base."""
        marks = table_at(self.spark, f"{self.target}/bases")
        return 0 if marks is None else marks.agg(F.max("upto")).first()[0] or 0

    def _base(self, upto: int) -> DataFrame | None:
        if not upto:
            return None
        name = f"{self.name}_{upto}"
        if not self.spark.catalog.tableExists(name):
            schema = self.spark.read.parquet(f"{self.target}/base={upto}").schema
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (fingerprint) SORTED BY (fingerprint) INTO {self.buckets} BUCKETS LOCATION '{self.target}/base={upto}'")
        return self.spark.table(name)

    def _merged(self, upto: int, below: int | None = None) -> DataFrame | None:
        """The base and the batches from `upto` on (and below `below`), as postings with the place of each filled field (<field>_at)."""
        base, batches = self._base(upto), table_at(self.spark, f"{self.target}/batches")
        fresh = None if batches is None else batches.where((F.col("batch") >= upto) & (F.lit(True) if below is None else F.col("batch") < below)).drop("batch", "bucket")
        if base is None or fresh is None:
            return base if fresh is None else fold(fresh, counted="sightings", placed=True)
        fresh = fold(fresh, counted="sightings", placed=True)
        filled = [c for c in ENRICHED if c in base.columns]
        rest = [c for c in base.columns if c not in ("fingerprint", "sightings", *filled, *(f"{c}_at" for c in filled))]
        # In as many partitions as the base has buckets, or Spark may choose to move both sides.
        b, f = base.alias("b"), fresh.repartition(self.buckets, "fingerprint").alias("f")
        old = F.col("f.seq").isNull() | (F.col("b.seq") <= F.col("f.seq"))
        pick = [F.when(old, F.col(f"b.{c}")).otherwise(F.col(f"f.{c}")).alias(c) for c in rest]
        for c in filled:
            first = F.col(f"f.{c}_at").isNull() | (F.col(f"b.{c}_at") <= F.col(f"f.{c}_at"))
            pick += [F.when(first, F.col(f"b.{c}")).otherwise(F.col(f"f.{c}")).alias(c), F.least(f"b.{c}_at", f"f.{c}_at").alias(f"{c}_at")]
        seen = (F.coalesce("b.sightings", F.lit(0)) + F.coalesce("f.sightings", F.lit(0))).alias("sightings")
        return b.join(f, F.col("b.fingerprint") == F.col("f.fingerprint"), "full").select(F.coalesce("b.fingerprint", "f.fingerprint").alias("fingerprint"), *pick, seen).select(base.columns)

    def read(self) -> DataFrame | None:
        """One row a fingerprint, as read_postings gives them; None where nothing is stored."""
        found = self._merged(self.covered())
        return None if found is None else found.drop(*(f"{c}_at" for c in ENRICHED))

    def compact(self, upto: int) -> None:
        """Stores the base of all batches below `upto`; with the mark that is written last it becomes the one that is read. Older bases stay until retire()."""
        before = self.covered()
        merged = None if upto <= before else self._merged(before, upto)
        if merged is None:
            return
        if not before:
            merged = merged.repartition(self.buckets, "fingerprint")  # later bases come in their buckets from the join
        name = f"{self.name}_{upto}"
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        removed(self.spark, f"{self.target}/base={upto}")
        merged.write.bucketBy(self.buckets, "fingerprint").sortBy("fingerprint").option("path", f"{self.target}/base={upto}").saveAsTable(name)
        self.spark.range(1).select(F.lit(upto).cast("long").alias("upto")).coalesce(1).write.mode("append").parquet(f"{self.target}/bases")

    def retire(self) -> None:
        """Deletes bases and batches that the newest base has taken in."""
        upto = self.covered()
        for r in table_at(self.spark, f"{self.target}/bases").where(F.col("upto") < upto).distinct().collect() if upto else []:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{r['upto']}")
            removed(self.spark, f"{self.target}/base={r['upto']}")
        batches = table_at(self.spark, f"{self.target}/batches")
        for r in batches.where(F.col("batch") < upto).select("batch").distinct().collect() if batches is not None else []:
            removed(self.spark, f"{self.target}/batches/batch={r['batch']}")
