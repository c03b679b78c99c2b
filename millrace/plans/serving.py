"""Postings published for reading: range-sorted files, and a small index of them, so that a page reads the files that hold it and no others.

A version lies in version=<number>/rows/part=<k>, newest postings first, beside an index
with a row for each part: its rows and its newest and oldest place (received_at, seq).
Readers take the newest whole version; the index is written after the rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..stored import removed, table_at, written

#: Postings of a part, on average.
PART_ROWS = 50_000
#: Parts of a version at most: each is a folder of its own, and a row of the index.
MOST_PARTS = 500


def publish(postings: DataFrame, target: str, version: int, part_rows: int = PART_ROWS) -> None:
    """Writes postings (received_at, seq, ...) as a version; seq is unique. Null instants come last, as oldest. A repeated version replaces itself.

    Postings that would take more than MOST_PARTS parts lie in as many, which hold more than
    `part_rows` then. They are stored first, as they are counted, sampled for ranges and written.
    """
    newest = [F.col("received_at").desc_nulls_last(), F.col("seq").desc()]
    postings = written(postings, "published")
    parts = min(MOST_PARTS, max(1, -(-postings.count() // part_rows)))
    ranged = postings.repartitionByRange(parts, *newest).withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", *newest)
    at = f"{target}/version={version}"
    ranged.write.mode("overwrite").partitionBy("part").parquet(f"{at}/rows")
    place = F.struct(F.col("received_at"), F.col("seq"))
    index = postings.sparkSession.read.schema(ranged.schema).parquet(f"{at}/rows").groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.max(place).alias("newest"), F.min(place).alias("oldest"))
    index.coalesce(1).write.mode("overwrite").parquet(f"{at}/index")


@dataclass
class Served:
    """A published version."""

    spark: SparkSession
    at: str
    index: DataFrame

    def _rows(self, parts: list[int]) -> DataFrame:
        """Only the folders of the named parts are listed and read."""
        rows = f"{self.at}/rows"
        if not parts:
            return self.spark.read.parquet(rows).limit(0)
        return self.spark.read.option("basePath", rows).parquet(*[f"{rows}/part={k}" for k in parts])

    def _counted(self) -> DataFrame:
        before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        return self.index.withColumn("before", F.coalesce(before, F.lit(0)))

    def page(self, number: int, size: int) -> DataFrame:
        """Page `number` (from 1) of `size` postings, newest first, ties by descending seq: the parts that hold it, and of those the rows."""
        first, last = (number - 1) * size, number * size
        held = self._counted().where((F.col("before") < last) & (F.col("before") + F.col("rows") > first)).select("part", "before").collect()
        rows = self._rows([r["part"] for r in held])
        return _newest(rows).offset(first - min((r["before"] for r in held), default=first)).limit(size)

    def after(self, received_at: datetime | None, seq: int, size: int) -> DataFrame:
        """The `size` postings that follow the one at (received_at, seq), so that pages hold still while others are published."""
        place = F.struct(F.lit(received_at).cast("timestamp").alias("received_at"), F.lit(seq).cast("long").alias("seq"))
        older = self._counted().where(F.col("oldest") < place)
        # The part that holds the place may have no more than one older posting; the parts behind it are whole.
        start = older.agg(F.min(F.struct("part", "before", "rows")).alias("p")).first()["p"]
        if start is None:
            return self._rows([]).drop("part")
        whole = start["before"] + start["rows"]
        parts = [start["part"], *(r["part"] for r in older.where((F.col("part") > start["part"]) & (F.col("before") < whole + size)).select("part").collect())]
        return _newest(self._rows(parts).where(F.struct("received_at", "seq") < place)).limit(size)

    def count(self) -> int:
        """All postings, from the index."""
        return self.index.agg(F.sum("rows")).first()[0] or 0


def _newest(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("received_at").desc_nulls_last(), F.col("seq").desc()).drop("part")


def served(spark: SparkSession, target: str, version: int) -> Served | None:
    """A version that has been published; None where it hasn't, or not wholly."""
    index = table_at(spark, f"{target}/version={version}/index")
    return None if index is None else Served(spark, f"{target}/version={version}", index)


def retire(spark: SparkSession, target: str, version: int) -> None:
    """Deletes a version that nobody reads any more."""
    removed(spark, f"{target}/version={version}")
