"""Posting dates from relative and explicit phrases, always against a reference instant from the data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import once

# Patterns of the phrases.
EXPLICIT = r"(?i)posted\s+(?:on\s+)?([A-Za-z]{3,9}\.?\s+\d{1,2},?\s+\d{4})"
ISO = r"(?i)posted\s+(?:on\s+)?(\d{4}-\d{2}-\d{2})"
AGO = r"(?i)(?:posted\s*:?\s*)?(?:(\d+)\s*(minutes?|mins?|hours?|hrs?|days?|weeks?|months?|years?)\s+ago|just\s+now)"
YESTERDAY, TODAY = r"(?i)posted\s+yesterday", r"(?i)posted\s+today|new\s+job\s+posted\s+today"


def posted_at(text: Column, reference: Column) -> Column:
    """The instant that a phrase names, or null; an instant after the reference is null too.

    Months and years are calendar steps with the day clamped. A count too large for a
    timestamp is null.
    """
    # Explicit dates name a year.
    dated = F.when(text.rlike(r"\d{4}"), text)
    day = F.regexp_replace(F.regexp_replace(F.nullif(F.regexp_extract(dated, EXPLICIT, 1), F.lit("")), r"[.,]", " "), r"\s+", " ")
    day = F.regexp_replace(day, "(?i)^sept ", "Sep ")
    named = once(day, lambda day: F.coalesce(F.try_to_timestamp(day, F.lit("MMM d yyyy")), F.try_to_timestamp(day, F.lit("MMMM d yyyy"))))
    explicit = F.coalesce(named, F.try_to_timestamp(F.nullif(F.regexp_extract(dated, ISO, 1), F.lit("")), F.lit("yyyy-MM-dd")))
    step = F.struct(F.regexp_extract(text, AGO, 1).try_cast("int").alias("n"), F.lower(F.regexp_extract(text, AGO, 2)).alias("unit"))
    relative = F.when(text.rlike(AGO), once(step, lambda s: _before(reference, F.when(s["n"] < 100_000, s["n"]), s["unit"]))).when(text.rlike(YESTERDAY), reference - F.expr("interval 1 day")).when(text.rlike(TODAY), reference)
    return once(F.coalesce(explicit, relative), lambda found: F.when(found <= reference, found))


def _before(reference: Column, n: Column, unit: Column) -> Column:
    """The instant n units before another; that itself without a unit."""
    months = F.when(F.startswith(unit, F.lit("month")), n).when(F.startswith(unit, F.lit("year")), n * 12).otherwise(0)
    minutes = F.when(F.startswith(unit, F.lit("min")), n).when(F.startswith(unit, F.lit("h")), n * 60).when(F.startswith(unit, F.lit("day")), n * 1440).when(F.startswith(unit, F.lit("week")), n * 10080).otherwise(0)
    ago = reference - F.make_ym_interval(F.lit(0), months.cast("int")) - F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))
    return F.when(unit == "", reference).otherwise(ago)
