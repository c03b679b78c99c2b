"""A stated query set against all rows of a stored table, which stay where they lie.

Queries travel and rows don't: queries are cut into groups of a bounded number of bytes,
and one job a group broadcasts it and scans the table's files in place. No row of either
side is copied into pairs, and nothing is shuffled but what a scan passes on. A group's
answers are a folder of the result; groups run one after another, each over all cores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Shelf

#: Bytes of queries that one job broadcasts, on average over groups.
GROUP_BYTES = 16 << 20
#: Tasks that write a group.
SHARES = 8


def answers(queries: DataFrame, rows: DataFrame, key: str, row_bytes: str, scan: Callable[[pa.Table, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, shelf: Shelf, name: str) -> DataFrame:
    """The stored answers `scan` gives for each group of queries and each partition of rows.

    `key` is a column that tells queries apart and deals them to groups; `row_bytes` is an
    SQL expression of a query's size.
    """
    spark = queries.sparkSession
    total = queries.agg(F.sum(F.expr(row_bytes))).first()[0] or 0
    groups = -(-total // GROUP_BYTES)
    asked = queries.withColumns({"group": F.pmod(F.xxhash64(key), F.lit(max(groups, 1))).cast("int"), "_share": F.pmod(F.xxhash64(key, F.lit(1)), F.lit(SHARES))})
    asked = shelf.put(asked.repartition("group", "_share").drop("_share"), f"{name}_asked", by="group")
    for g in range(groups):
        sent = spark.sparkContext.broadcast(asked.where(F.col("group") == g).drop("group").toArrow())
        shelf.put(rows.mapInArrow(lambda batches, sent=sent: scan(sent.value, batches), schema), f"{name}/group={g}")
        sent.unpersist()
    shelf.drop(f"{name}_asked")
    if not groups:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[shelf.path(f"{name}/group={g}") for g in range(groups)])
