"""Monthly trend, month-over-month change, regression features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillstar.functions import numbers as n
from tillstar.operators import months as m
from tillstar.operators.metric import metric


@metric("order_date", "sales", summed=True, monthly=True)
def monthly_sales(df: DataFrame) -> DataFrame:
    return m.monthly_totals(df, ["sales"]).select(m.MONTH, n.real(F.col("sales")).alias("sales"))


@metric("order_date", "sales", summed=True, monthly=True)
def monthly_trend(df: DataFrame) -> DataFrame:
    """Month sums with their three-month trailing mean."""
    return m.monthly_totals(df, ["sales"]).select(
        m.MONTH, n.real(F.col("sales")).alias("sales"), m.trailing_mean("sales").alias("ma")
    )


def _with_change(df: DataFrame) -> DataFrame:
    series = m.monthly_totals(df, ["sales"])
    previous = F.lag("sales").over(m.timeline())
    change = F.try_divide(n.real(F.col("sales")) - n.real(previous), n.real(previous)) * 100
    return series.withColumns({"prev_sales": previous, "mom_pct": change})


@metric("order_date", "sales", summed=True, monthly=True)
def mom_change(df: DataFrame) -> DataFrame:
    """Each month against the one before; null for the first and after an empty month."""
    return _with_change(df).select(
        F.date_format(m.MONTH, "yyyy-MM").alias("month"),
        F.date_format(m.MONTH, "MMM yyyy").alias("label"),
        n.real(F.col("sales")).alias("sales"),
        "mom_pct",
    )


@metric("order_date", "sales", summed=True, monthly=True)
def mom_last(df: DataFrame) -> DataFrame:
    """The last month beside the one before; no row with fewer than two months."""
    before = F.lag(m.MONTH).over(m.timeline())
    last = _with_change(df).withColumn("prev_month", before).orderBy(F.desc(m.MONTH)).limit(1)
    pct = F.bround("mom_pct", 1)
    return last.filter(F.col("prev_month").isNotNull()).select(
        F.date_format(m.MONTH, "MMM yyyy").alias("current_month"),
        n.real(F.col("sales")).alias("current_sales"),
        n.money_short(F.col("sales")).alias("current_fmt"),
        F.date_format("prev_month", "MMM yyyy").alias("prev_month"),
        n.real(F.col("prev_sales")).alias("prev_sales"),
        n.money_short(F.col("prev_sales")).alias("prev_fmt"),
        pct.alias("mom_pct"),
        n.trend_sign(pct).alias("mom_trend"),
    )


def with_features(series: DataFrame, measure: str, partition_by=()) -> DataFrame:
    """Regression features of a dense month series: t, month, lag_1, lag_12, ma_3.

    Missing leading lags are back-filled, which for a shifted series means its
    first value; lag_12 stays null for a series of 12 months or fewer.
    """
    line = m.timeline(partition_by)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(measure).over(whole)
    length = F.count(F.lit(1)).over(whole)

    def lag(k: int):
        return F.when(length > k, F.coalesce(F.lag(measure, k).over(line), first))

    return series.select(
        *partition_by,
        m.MONTH,
        n.real(F.col(measure)).alias("value"),
        (F.row_number().over(line) - 1).alias("t"),
        F.month(m.MONTH).alias("month"),
        n.real(lag(1)).alias("lag_1"),
        n.real(lag(12)).alias("lag_12"),
        m.trailing_mean(measure, partition_by=partition_by).alias("ma_3"),
    )


@metric("order_date", "sales", summed=True, monthly=True)
def forecast_features(df: DataFrame) -> DataFrame:
    return with_features(m.monthly_totals(df, ["sales"]), "sales")


@metric("order_date")
def month_spine(df: DataFrame, ahead: int = 6) -> DataFrame:
    return m.month_spine(df, ahead=ahead)
