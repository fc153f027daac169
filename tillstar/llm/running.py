"""Ranks and running totals within hot groups, in a seeded random order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one numbered piece has on average, and the most pieces there are.
PIECE_ROWS, MOST_PIECES = 512, 65_536


def piece_count(n_rows: int) -> int:
    """Pieces for ``n_rows``: small ones, but never more than a window can list."""
    return min(n_rows // PIECE_ROWS + 1, MOST_PIECES)


def seeded_key(seed: int, *columns: str) -> Column:
    """Reproducible pseudo-random text of 32 hexadecimal digits per row."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def piece_of_key(key: Column, pieces: int) -> Column:
    """Number of the piece of a seeded key; pieces follow the order of keys."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") * F.lit(pieces) / F.lit(1 << 32))


def non_null(name: str) -> Column:
    """A text that is never null and differs for null and for any value."""
    return F.when(F.col(name).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(name).cast("string")))


def with_offsets(
    df: DataFrame, group: str, piece: str, order: Sequence[str], value: Column, offset: str, total: str
) -> DataFrame:
    """Add ``offset``, the sum of ``value`` over the earlier rows of the group,
    and ``total``, its sum over the whole group.

    Rows are ordered by (``piece``, ``order``) within ``group``; both are never
    null. No group is numbered in one task: each piece is numbered on its own
    and shifted by the totals of the pieces before it. Rows that agree in
    ``order`` must agree in every column that matters.
    """
    valued = df.withColumn("_value", value)
    by_piece = Window.partitionBy(group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        valued.groupBy(group, piece)
        .agg(F.sum("_value").alias("_sum"))
        .withColumn("_shift", F.coalesce(F.sum("_sum").over(by_piece), F.lit(0)))
        .withColumn(total, F.sum("_sum").over(Window.partitionBy(group)).cast("bigint"))
        .drop("_sum")
    )
    within = Window.partitionBy(group, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        valued.withColumn("_before", F.coalesce(F.sum("_value").over(within), F.lit(0)))
        .join(shifts, [group, piece])
        .withColumn(offset, (F.col("_before") + F.col("_shift")).cast("bigint"))
        .drop("_shift", "_before", "_value")
    )
