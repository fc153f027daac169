"""Metrics as plain functions that name the view columns they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tillstar.operators.slices import Slice


def metric(*columns: str, summed: bool = False, monthly: bool = False) -> Callable:
    """Record on a ``(view, …) -> DataFrame`` function which columns it reads.

    ``summed`` says that it reads sales, profit and quantity through sums only,
    so the source may hand it rows that are added up already; ``monthly`` that
    any day of the right month does for ``order_date``.
    """

    def mark(function: Callable) -> Callable:
        function.columns = columns
        function.summed = summed
        function.monthly = monthly
        return function

    return mark


def known(df: DataFrame, *keys: str) -> DataFrame:
    """Rows with every key: a report has no line for an unknown member."""
    return df.dropna(subset=list(keys))


def compute(function: Callable, source, within: Slice | None = None, **options) -> DataFrame:
    """Run a metric over ``source.view`` cut down to its columns and slice.

    A slice asks for single lines: its filters then reach the dimensions that
    the lines meet first, and what is summed, sorted or joined later is only
    the slice. A source that holds aggregates answers from them where they
    cover the metric and the slice.
    """
    within = within or Slice()
    if hasattr(source, "covering"):
        source = source.covering(function, within)
    return function(sliced_view(function, source, within), **options)


def sliced_view(function: Callable, source, within: Slice) -> DataFrame:
    """What a metric reads of a slice."""
    extra = [c for c in within.columns if c not in function.columns]
    summed = function.summed and not within.columns
    return within.apply(source.view(*function.columns, *extra, summed=summed))
