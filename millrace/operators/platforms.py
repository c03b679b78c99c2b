"""Platforms as rows of a table: which of them a sender or URL belongs to, and its URL rules as a column.

The table has slug, domain, priority, enabled, required, tracking, alias, id_patterns and
host, as rules.PLATFORMS has them; another platform is another row.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from .rule_join import containing

SCHEMA = "slug string, domain string, priority int, required array<string>, tracking array<string>, alias string, id_patterns array<string>, host string, enabled boolean"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def platform_table(spark: SparkSession) -> DataFrame:
    """The platforms of rules.PLATFORMS as rows."""
    rows = [{k: list(v) if isinstance(v, tuple) else v for k, v in asdict(p).items()} for p in rules.PLATFORMS]
    return spark.createDataFrame([tuple(r[n] for n in _NAMES) for r in rows], SCHEMA)


def with_platform(rows: DataFrame, platforms: DataFrame, key: str, text: str, name: str = "platform", named: str | None = None, enabled: bool = False) -> DataFrame:
    """Rows with a struct `name` of the platform whose domain `text` contains, the first by priority (then slug); null where none is.

    `key` is unique. `named` is a column of slugs that go first where the table has them.
    With `enabled`, only enabled platforms count.
    """
    table = (platforms.where("enabled") if enabled else platforms).dropDuplicates(["slug"])
    one = F.struct("priority", *[c for c in _NAMES if c != "priority"])
    found = containing(rows.select(key, text), table, key, text, "domain").groupBy(key).agg(F.min(one).alias(name))
    out = rows.join(found, key, "left")
    if named is None:
        return out
    own = table.select(F.col("slug").alias("_slug"), one.alias("_own"))
    return out.join(own, out[named] == own["_slug"], "left").withColumn(name, F.coalesce("_own", name)).drop("_slug", "_own")
