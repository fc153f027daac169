"""Exact distinct counts that roll up: bitmaps of numbered members.

A distinct count of a cell says nothing about the count of several cells
together. A bitmap does: cells are merged by OR and counted afterwards, without
reading the rows again and without multiplying them per distinct column. A
bitmap holds one bucket of 32,768 consecutive numbers, so its size is fixed and
members that are numbered side by side share it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_cells(df: DataFrame, keys: Sequence[str], number: str, name: str) -> DataFrame:
    """``keys``, bucket and the bitmap ``name`` of the numbers seen with them.

    ``number`` is a non-negative integer column; null is no member. Rows are
    made distinct first, with a combine on the map side, so a hot key or a
    member with many rows reaches the bitmaps once per task. The numbers of a
    bitmap meet before it is built: an exchange moves and sorts them, and not
    bitmaps of 4 KiB with a few bits set.
    """
    once = df.filter(F.col(number).isNotNull()).select(*keys, number).distinct()
    dealt = once.withColumn("bucket", F.bitmap_bucket_number(F.col(number))).repartition(*keys, "bucket")
    return dealt.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(number))).alias(name))


def roll_up(cells: DataFrame, keys: Sequence[str], name: str, count: str) -> DataFrame:
    """``keys`` and the exact number of distinct members over all their cells."""
    merged = cells.groupBy(*keys, "bucket").agg(F.bitmap_or_agg(name).alias(name))
    return merged.groupBy(*keys).agg(F.sum(F.bitmap_count(name)).alias(count))
