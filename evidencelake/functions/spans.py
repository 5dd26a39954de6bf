"""Reporting periods as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical lengths of reporting spans in days, and how far off a length may be.
CANONICAL = {"Q": 91, "H": 182, "9M": 273, "FY": 365}
TOLERANCE = 25


def period_days(start: Column, end: Column) -> Column:
    """Inclusive length in days; null for an instant."""
    return F.date_diff(end, start) + 1


def classify(days: Column) -> Column:
    """``instant`` for null, the one canonical span within TOLERANCE (they don't overlap), else ``other``."""
    out = F.when(days.isNull(), "instant")
    for name, n in CANONICAL.items():
        out = out.when(days.between(n - TOLERANCE, n + TOLERANCE), name)
    return out.otherwise("other")


def period_type(start: Column) -> Column:
    return F.when(start.isNull(), "instant").otherwise("duration")


def iso_date(text: Column) -> Column:
    """A date from the first ten characters, null where they aren't one."""
    return F.try_to_date(F.substring(F.trim(text), 1, 10), "yyyy-MM-dd")
