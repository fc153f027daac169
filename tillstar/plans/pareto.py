"""Concentration of revenue over products or customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstar.functions import numbers as n
from tillstar.operators.metric import metric
from tillstar.operators.ordered import with_running_totals


def _curve(df: DataFrame, member: str) -> DataFrame:
    """Members by falling revenue with exact running revenue, size and total.

    Members are unbounded (customers), so the order is distributed.
    """
    sums = (
        df.filter(F.col(member).isNotNull())
        .groupBy(F.col(member).alias("member"))
        .agg(n.total(F.col("sales")).alias("revenue"))
    )
    return with_running_totals(
        sums,
        [F.desc("revenue"), F.asc("member")],
        running={"so_far": "revenue"},
        size="members",
        totals={"whole": "revenue"},
    )


def _share(part: str):
    return n.ratio(F.col(part), F.col("whole")) * 100


def _position_pct():
    return n.ratio(F.col("position"), F.col("members")) * 100


@metric("product_name", "sales", summed=True)
def products(df: DataFrame) -> DataFrame:
    """The whole curve: revenue, cumulative share and position per product."""
    return _curve(df, "product_name").select(
        "position",
        F.col("member").alias("product_name"),
        n.real(F.col("revenue")).alias("revenue"),
        _share("so_far").alias("cum_pct"),
        _position_pct().alias("product_pct"),
    )


def _top_fifth(curve: DataFrame):
    size = F.greatest(F.lit(1), F.floor(F.col("members") / 5)).cast("bigint")
    return curve.withColumn("_fifth", size)


@metric("product_name", "sales", summed=True)
def product_summary(df: DataFrame) -> DataFrame:
    """Revenue share of the top fifth, the point on the curve at 15-25 % of the
    products (``*_at_cut``; the sixth product when there are fewer than 20), and
    the share of products that brings 80 % of the revenue.
    """
    curve = _top_fifth(_curve(df, "product_name"))
    few = F.least(F.lit(6).cast("bigint"), F.col("members"))
    in_band = _position_pct().between(15, 25)
    at_cut = F.when(F.col("members") >= 20, in_band).otherwise(F.col("position") == few)
    summary = curve.agg(
        F.max("members").alias("total_products"),
        F.max("_fifth").alias("top20_products_count"),
        F.max("whole").alias("whole"),
        F.max(F.when(F.col("position") == F.col("_fifth"), F.col("so_far"))).alias("_fifth_sum"),
        F.min(F.when(at_cut, _position_pct())).alias("_cut_position"),
        F.min(F.when(at_cut, F.struct(F.col("position"), _share("so_far").alias("pct")))).alias("_cut"),
        F.min(F.when(_share("so_far") >= 80, _position_pct())).alias("_at_80"),
    )
    return summary.filter(F.col("total_products").isNotNull()).select(
        "total_products",
        "top20_products_count",
        n.pct(F.col("_fifth_sum"), F.col("whole")).alias("top20_revenue_share"),
        F.bround("_cut_position", 1).alias("pct_products_at_cut"),
        F.bround("_cut.pct", 1).alias("pct_revenue_at_cut"),
        F.bround("_at_80", 1).alias("pct_products_for_80"),
    )


@metric("customer_name", "sales", summed=True)
def customer_summary(df: DataFrame) -> DataFrame:
    curve = _top_fifth(_curve(df, "customer_name"))
    summary = curve.agg(
        F.max("members").alias("total_customers"),
        F.max("_fifth").alias("top20_customers_count"),
        F.max("whole").alias("whole"),
        F.max(F.when(F.col("position") == F.col("_fifth"), F.col("so_far"))).alias("_fifth_sum"),
    )
    return summary.filter(F.col("total_customers").isNotNull()).select(
        "total_customers",
        "top20_customers_count",
        n.pct(F.col("_fifth_sum"), F.col("whole")).alias("top20_revenue_share"),
    )
