"""Tables and folders that driver and executors share, and small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stored import fresh_path


class Shelf:
    """Parquet tables of one operator run in the shared folder.

    A table that is written and read again cuts the lineage: what is lost with an
    executor is computed from the table on, and the table itself outlives executors.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = fresh_path(spark, label)
        self.names: list[str] = []

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Stores a table and reads it back; `by` names a column whose values get folders of their own."""
        self.names.append(name)
        df.write.option("compression", "zstd").parquet(self.path(name), partitionBy=by)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep(self, *names: str) -> None:
        """Deletes all tables but these."""
        self.drop(*[n for n in self.names if n not in names])

    def drop(self, *names: str) -> None:
        """Deletes tables, or folders of them ("table/column=value"), that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_name(wanted: str, *taken: list[str]) -> str:
    """A column name that none of the lists holds, upper and lower case alike."""
    low = {c.lower() for names in taken for c in names}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
