"""Field columns read from a block of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import once

# Patterns of the fields.
REMOTE = r"(?i)\b(remote|hybrid|on-?site)\b"
EMPLOYMENT = r"(?i)\b(full[\s-]?time|part[\s-]?time|contract(?:or)?|temporary|temp\b|internship|intern\b|permanent|freelance)\b"
SALARY_CURRENCY = (
    r"(?:[$€£]|USD|EUR|GBP|PKR|Rs\.?)\s?\d[\d,.]*\s*[KkMm]?(?:\s*[-–—]\s*(?:[$€£]|USD|EUR|GBP|PKR|Rs\.?)?\s?\d[\d,.]*\s*[KkMm]?)?"
    r"(?:\s*(?:a|per|/)\s*(?:year|yr|month|mo\b|week|wk\b|day|hour|hr))?"
)
SALARY_PLAIN = r"\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\s*[-–—]\s*\d{1,3}(?:,\d{3})+(?:\.\d+)?(?:\s*(?:a|per|/)\s*(?:year|yr|month|week|day|hour|hr))?"
POSTED = r"(?i)(?:posted\s*:?\s*)?(just\s+now|\d+\s*(?:minutes?|mins?|hours?|hrs?|days?|weeks?|months?|years?)\s+ago)"
PROMOTED = r"(?i)\b(promoted|sponsored)\b"
COMPANY_LOCATION = r"^([A-Za-z][A-Za-z0-9 .,&()'/-]*?)\s+[-–—]\s+([A-Za-z][A-Za-z .,'()-]*)$"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def begins(letters: str, pattern: str) -> str:
    """A pattern that is tried only where one of the letters is with which all that it finds begins."""
    return f"(?=[{letters}]){pattern}"


def remote_type(text: Column) -> Column:
    return F.replace(F.lower(_found(text, begins("RrHhOo", REMOTE))), F.lit("on-site"), F.lit("onsite"))


def employment_type(text: Column) -> Column:
    found = F.replace(F.lower(_found(text, begins("FfPpCcTtIi", EMPLOYMENT))), F.lit(" "), F.lit("-"))
    return F.replace(found, F.lit("contractor"), F.lit("contract"))


def _where(text: Column, mark: str, found: Column) -> Column:
    """What a pattern finds, searched for only where the mark, a part of all that it can find, is; else an empty text."""
    return F.when(text.rlike(mark), found).when(text.isNotNull(), "")


def salary(text: Column) -> Column:
    currency, plain = F.regexp_extract(text, f"({SALARY_CURRENCY})", 1), F.regexp_extract(text, f"({SALARY_PLAIN})", 1)
    found = once(_where(text, r"[$€£DPRs.]\s?\d", currency), lambda found: F.when(found == "", _where(text, r"\d,\d\d\d", plain)).otherwise(found))
    return F.trim(F.regexp_replace(F.nullif(found, F.lit("")), r"\s+", " "))


def posted_phrase(text: Column) -> Column:
    return F.nullif(_where(text, r"(?i)\s(?:ago|now)", F.regexp_extract(text, begins("PpJj0-9", POSTED), 0)), F.lit(""))


def is_promoted(text: Column) -> Column:
    return text.rlike(begins("PpSs", PROMOTED))


def company_of(line: Column) -> Column:
    return company_and_place(line)["company"]


def location_of(line: Column) -> Column:
    return company_and_place(line)["location"]


def company_and_place(line: Column) -> Column:
    """struct(company, location) of a line "company - place"; null where it names none."""
    place, found = F.regexp_extract(line, COMPANY_LOCATION, 2), lambda c: F.nullif(c, F.lit(""))
    return once(place, lambda place: F.when(F.contains(place, F.lit(",")) | place.rlike(REMOTE), F.struct(found(F.regexp_extract(line, COMPANY_LOCATION, 1)).alias("company"), found(place).alias("location"))))


def is_reliable_title(title: Column) -> Column:
    title = F.trim(F.coalesce(title, F.lit("")))
    return (F.length(title) >= 3) & title.rlike(r"[\p{L}\p{N}]") & (F.contains(title, F.lit(" ")) | (F.length(title) >= 6))


def search_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def location_matches(asked: Column, place: Column) -> Column:
    """True for an empty request; false for an empty place; otherwise whether any word is shared."""
    asked, place = search_text(asked), search_text(place)
    return F.when(asked == "", True).when(place == "", False).otherwise(F.arrays_overlap(F.split(asked, " "), F.split(place, " ")))
