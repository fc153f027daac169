"""First row per key and surrogate-key lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], values: Sequence[str], arrival: str) -> DataFrame:
    """``values`` of the earliest row per key in ``arrival`` order.

    Ties fall to the smallest values, so the result does not depend on the
    order in which tasks finish. Distinct rows are formed first: that step is a
    hash aggregate combined on the map side, so a hot key costs no more than
    its few distinct value tuples.
    """
    distinct = df.groupBy(*keys, *values).agg(F.min(arrival).alias("_arrival"))
    first = distinct.groupBy(*keys).agg(
        F.min(F.struct(F.col("_arrival"), *[F.col(v) for v in values])).alias("_first")
    )
    return first.select(*keys, *[F.col(f"_first.{v}").alias(v) for v in values])


def last_key(dim: DataFrame, keys: Sequence[str], surrogate: str) -> DataFrame:
    """Largest surrogate per (possibly repeated) composite key."""
    return dim.groupBy(*keys).agg(F.max(surrogate).alias(surrogate))


def lookup_key(
    fact: DataFrame,
    dim: DataFrame,
    on: Mapping[str, str],
    surrogate: str,
    as_name: str | None = None,
    unknown: int = 1,
) -> DataFrame:
    """Left join on ``on`` (fact column -> dim column), unknown keys to ``unknown``.

    ``dim`` must be unique on its join columns. No broadcast is forced: Spark
    picks it from the dimension's file size, and adaptive execution splits a
    hot key of the fact otherwise.
    """
    renamed = dim.select(
        *[F.col(d).alias(f"_key_{d}") for d in on.values()], F.col(surrogate).alias("_found")
    )
    test: Column | None = None
    for f, d in on.items():
        part = fact[f] == renamed[f"_key_{d}"]
        test = part if test is None else test & part
    joined = fact.join(renamed, test, "left")
    return joined.withColumn(
        as_name or surrogate, F.coalesce(F.col("_found"), F.lit(unknown)).cast("bigint")
    ).drop("_found", *[f"_key_{d}" for d in on.values()])
