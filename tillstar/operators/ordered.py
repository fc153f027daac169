"""Global order over unbounded groups: positions, running totals, dense keys.

A window without ``partitionBy`` moves every row into one task. Here the rows
are range-partitioned in the wanted order, each slice is numbered on its own,
and only one row per slice (its count and sums) goes through a global window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillstar.session import settle

_SLICE = "_slice"


def with_running_totals(
    df: DataFrame,
    order_by: Sequence[Column],
    running: Mapping[str, str] | None = None,
    position: str = "position",
    size: str | None = None,
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add the 1-based ``position`` in ``order_by`` order, and per ``running``
    item (new column -> summed column) the cumulative sum up to the row.

    ``size`` names a column for the row count, ``totals`` (new column -> summed
    column) columns for grand totals. ``order_by`` must be unique per row.
    """
    running = dict(running or {})
    totals = dict(totals or {})
    summed = sorted(set(running.values()) | set(totals.values()))
    # written out, so that slice numbers and slice totals come from one run
    ranged = settle(
        df.repartitionByRange(*order_by).withColumn(_SLICE, F.spark_partition_id()), "ranged"
    )
    slices = ranged.groupBy(_SLICE).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_sum_{c}") for c in summed]
    )
    # one row per shuffle partition
    earlier = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(_SLICE).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    columns = [
        F.col(_SLICE),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows_before"),
    ]
    for c in summed:
        columns.append(F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}"))
    if size:
        columns.append(F.sum("_n").over(everything).alias(size))
    for name, c in totals.items():
        columns.append(F.sum(f"_sum_{c}").over(everything).alias(name))
    offsets = slices.select(*columns)

    within = Window.partitionBy(_SLICE).orderBy(*order_by)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = ranged.join(F.broadcast(offsets), _SLICE).withColumn(
        position, (F.row_number().over(within) + F.col("_rows_before")).cast("bigint")
    )
    for name, c in running.items():
        numbered = numbered.withColumn(name, F.sum(c).over(upto) + F.col(f"_before_{c}"))
    return numbered.drop(_SLICE, "_rows_before", *[f"_before_{c}" for c in summed])


def with_dense_key(df: DataFrame, key: str, order_by: Sequence[str], start: int = 1) -> DataFrame:
    """Add surrogate key ``start, start+1, …`` in ``order_by`` order."""
    numbered = with_running_totals(df, [F.asc_nulls_first(c) for c in order_by], position=key)
    if start != 1:
        numbered = numbered.withColumn(key, F.col(key) + (start - 1))
    return numbered.select(key, *df.columns)
