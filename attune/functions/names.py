"""Spelling of system names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_name(name: Column) -> Column:
    """Lower case, trimmed, ``_`` and inner blanks as ``-``; blank or null names give null.

    Deterministic per value, so equal systems written differently meet in one group.
    """
    cleaned = F.regexp_replace(F.lower(F.trim(F.regexp_replace(name, r"[\s ]+", " "))), "[ _]+", "-")
    return F.when(F.length(cleaned) > 0, cleaned)
