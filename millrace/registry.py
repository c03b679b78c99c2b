"""Where query modules put their queries and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def listed(values) -> str:
    """A SQL list of strings."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def picked(values, k: str) -> str:
    """SQL for the value at place k, counted around."""
    return f"{listed(values)}[CAST(({k}) % {len(values)} + 1 AS INT)]"


#: SQL: all lines of all documents, numbered from 1.
LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INT) AS line FROM documents)"


def document_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line, text) of all lines of all documents, numbered from 1."""
    rows = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return rows.withColumn("line", F.col("line") + 1)
