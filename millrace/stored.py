"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which the driver and all executors must see.

    Where that is unset, a folder beside the warehouse is used on one machine (master
    "local[...]"); on a cluster there is nothing to fall back to, and this raises.
    """
    found = spark.conf.get(_SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {_SETTING} to a folder that the driver and all executors can see")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-shared"
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no table has yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Of each scratch() that is open, the tables written so far.
_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what written() has stored inside it: for runs whose results are stored or collected by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            removed(spark, path)


def written(df: DataFrame, label: str) -> DataFrame:
    """The table, written once and read back, for plans that use it several times; it stays until the scratch() around it ends."""
    path = fresh_path(df.sparkSession, label)
    for tables in _OPEN[-1:]:
        tables.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder, where there is one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def table_at(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at a path; None where nothing is stored yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


#: Rows of a part that is dealt out; expressions on URLs and texts take some tenths of a millisecond a row.
PART_ROWS = 50_000


def spread(df: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """An input dealt out anew, over all cores and in parts of `part_rows` rows at most on average.

    How a file splits says nothing of its rows: a Parquet file may give more splits than there
    are cores, and have all rows in the few that hold the start of a row group.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // part_rows)))
