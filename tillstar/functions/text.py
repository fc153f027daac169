"""Text and date clean-up, and column lookup by alternative names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW_DATE = "d/M/yyyy"  # accepts one- and two-digit days and months


def squeeze(text: Column) -> Column:
    """Collapse every run of white space, non-breaking spaces included, and trim."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def raw_date(text: Column, strict: bool = False) -> Column:
    """Day from ``d/M/yyyy`` text; bad text becomes null, or raises when ``strict``."""
    return F.to_date(text, RAW_DATE) if strict else F.try_to_date(text, RAW_DATE)


def column_name(df: DataFrame, *candidates: str) -> str:
    """First of ``candidates`` that ``df`` has."""
    for name in candidates:
        if name in df.columns:
            return name
    raise KeyError(f"none of {candidates} in {df.columns}")


def snake(name: str) -> str:
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def with_snake_names(df: DataFrame) -> DataFrame:
    """Title-case headers (``Order ID``, ``Sub-Category``) to snake case."""
    return df.withColumnsRenamed({name: snake(name) for name in df.columns})
