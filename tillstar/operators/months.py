"""Dense month-end series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONTH = "month_end"


def monthly_totals(
    df: DataFrame,
    measures: Sequence[str],
    date: str = "order_date",
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Sum ``measures`` per month end, with a zero row for every missing month
    between the first and the last.

    The fact is aggregated once; the fill works on at most one row per calendar
    month, where each month also emits the empty months up to the next one.
    """
    present = (
        df.filter(F.col(date).isNotNull())
        .groupBy(*partition_by, F.trunc(date, "month").alias("_month"))
        .agg(*[F.sum(m).alias(m) for m in measures])
    )
    timeline = Window.partitionBy(*partition_by).orderBy("_month")
    following = F.coalesce(F.add_months(F.lead("_month").over(timeline), -1), F.col("_month"))
    spread = present.withColumn("_until", following).withColumn(
        "_each", F.explode(F.expr("sequence(_month, _until, interval 1 month)"))
    )
    return spread.select(
        *partition_by,
        F.last_day("_each").alias(MONTH),
        *[
            F.when(F.col("_each") == F.col("_month"), F.col(m))
            .otherwise(F.lit(0))
            .cast(present.schema[m].dataType)
            .alias(m)
            for m in measures
        ],
    )


def timeline(partition_by: Sequence[str] = ()):
    """Window over the months of one series (one row per calendar month)."""
    return Window.partitionBy(*partition_by).orderBy(MONTH)


def trailing_mean(measure: str, rows: int = 3, partition_by: Sequence[str] = ()) -> Column:
    """Mean of up to ``rows`` latest values; exact sums keep it order-independent."""
    frame = timeline(partition_by).rowsBetween(-(rows - 1), 0)
    return F.sum(measure).over(frame).cast("double") / F.count(measure).over(frame)


def month_spine(df: DataFrame, date: str = "order_date", ahead: int = 6) -> DataFrame:
    """Every month end from the first to the last date, then ``ahead`` future ones."""
    span = df.agg(F.min(date).alias("lo"), F.max(date).alias("hi")).select(
        F.trunc("lo", "month").alias("lo"), F.trunc("hi", "month").alias("hi")
    )
    months = span.select(
        "hi", F.explode(F.sequence("lo", F.add_months("hi", ahead), F.expr("interval 1 month"))).alias("m")
    )
    return months.select(F.last_day("m").alias(MONTH), (F.col("m") > F.col("hi")).alias("is_future"))
