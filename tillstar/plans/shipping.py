"""Delivery times and the money behind each ship mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstar.functions import numbers as n
from tillstar.operators.metric import known, metric

ON_TIME_DAYS = 5  # fixed value


def _delivered(df: DataFrame, *keep: str) -> DataFrame:
    """Rows with every named column present, and their delivery days."""
    needed = ["order_date", "ship_date", *keep]
    return df.dropna(subset=needed).withColumn("days", F.datediff("ship_date", "order_date"))


def _mean(column: str):
    return n.ratio(F.sum(column), F.count(column))


def _on_time_pct():
    on_time = F.count(F.when(F.col("days") <= ON_TIME_DAYS, 1))
    return F.bround(n.ratio(on_time, F.count("days")) * 100, 1)


@metric("order_date", "ship_date", "ship_mode")
def stats(df: DataFrame) -> DataFrame:
    return _delivered(df, "ship_mode").agg(
        F.bround(_mean("days"), 1).alias("avg_delivery_days"),
        _on_time_pct().alias("on_time_pct"),
        F.count("days").alias("total_orders"),
    )


@metric("order_date", "ship_date", "ship_mode")
def by_mode(df: DataFrame) -> DataFrame:
    """Mean, count and spread per mode; ``avg_whole_days`` is the mean cut to whole days."""
    sums = _delivered(df, "ship_mode").groupBy("ship_mode").agg(
        F.bround(_mean("days"), 1).alias("avg_days"),
        F.count("days").alias("orders"),
        F.bround(F.stddev_samp("days"), 1).alias("std_days"),
    )
    return sums.withColumn("avg_whole_days", F.col("avg_days").cast("int"))


@metric("order_date", "ship_date", "region")
def kpis_by_region(df: DataFrame) -> DataFrame:
    sums = _delivered(df, "region").groupBy("region").agg(
        F.bround(_mean("days"), 1).alias("avg_days"),
        _on_time_pct().alias("on_time_pct"),
        F.count("days").alias("orders"),
    )
    return sums.withColumn("band", n.on_time_band(F.col("on_time_pct")))


@metric("order_date", "ship_date", "region")
def delivery_days_by_region(df: DataFrame) -> DataFrame:
    means = _delivered(df, "region").groupBy("region").agg(_mean("days").alias("avg_days"))
    return means.orderBy(F.desc("avg_days"), "region").withColumn("avg_days_text", n.days_text(F.col("avg_days")))


@metric("order_date", "ship_date", "ship_mode")
def histogram(df: DataFrame) -> DataFrame:
    days = _delivered(df, "ship_mode").select(F.col("days").alias("delivery_days"), "ship_mode")
    return days.groupBy("delivery_days", "ship_mode").agg(F.count(F.lit(1)).alias("orders"))


@metric("ship_mode", "sales", "profit", "order_id", summed=True)
def mode_impact(df: DataFrame) -> DataFrame:
    sums = known(df, "ship_mode").groupBy("ship_mode").agg(
        n.total(F.col("sales")).alias("r"),
        n.total(F.col("profit")).alias("p"),
        F.count_distinct("order_id").alias("orders"),
    )
    return sums.select(
        "ship_mode",
        "orders",
        n.real(F.col("r")).alias("revenue"),
        n.money_short(F.col("r")).alias("revenue_fmt"),
        n.real(F.col("p")).alias("profit"),
        n.money_short(F.col("p")).alias("profit_fmt"),
        n.pct(F.col("p"), F.col("r")).alias("margin"),
    )


@metric("order_date", "ship_date")
def lines_per_month(df: DataFrame) -> DataFrame:
    dated = df.dropna(subset=["order_date", "ship_date"])
    return dated.groupBy(F.date_format("order_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("orders")
    )


@metric("order_id", "order_date", "ship_date")
def with_both_dates(df: DataFrame) -> DataFrame:
    """Order lines that have both dates."""
    return df.dropna(subset=["order_date", "ship_date"])
