"""Customer segments, top customers, purchase frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillstar.functions import numbers as n
from tillstar.operators.metric import known, metric

# Order-count bins (low, high, label).
FREQUENCY_BINS = ((1, 1, "1"), (2, 3, "2-3"), (4, 5, "4-5"), (6, 10, "6-10"), (11, None, "11+"))


@metric("segment", "sales", "order_id", "customer_name", "profit", "discount", "rated_lines", summed=True)
def segment_cards(df: DataFrame) -> DataFrame:
    sums = known(df, "segment").groupBy("segment").agg(
        n.total(F.col("sales")).alias("r"),
        F.count_distinct("order_id").alias("orders"),
        F.count_distinct("customer_name").alias("customers"),
        n.total(F.col("profit")).alias("p"),
        F.sum("discount").alias("d"),
        F.sum("rated_lines").alias("dn"),
    )
    per_order = F.coalesce(n.ratio(F.col("r"), F.col("orders")), F.lit(0.0))
    margin = n.pct_or_zero(F.col("p"), F.col("r"))
    return sums.select(
        "segment",
        "customers",
        n.real(F.col("r")).alias("revenue"),
        n.money_short(F.col("r")).alias("revenue_fmt"),
        "orders",
        per_order.alias("avg_order"),
        n.money_short(per_order).alias("avg_order_fmt"),
        margin.alias("margin"),
        n.segment_margin_band(margin).alias("band"),
        n.pct(F.col("d"), F.col("dn")).alias("avg_discount_pct"),
    )


@metric("segment", "sales", "profit", "discount", "rated_lines", summed=True)
def segment_margin(df: DataFrame) -> DataFrame:
    sums = known(df, "segment").groupBy("segment").agg(
        n.total(F.col("sales")).alias("r"),
        n.total(F.col("profit")).alias("p"),
        F.sum("discount").alias("d"),
        F.sum("rated_lines").alias("dn"),
    )
    margin = n.pct(F.col("p"), F.col("r"))
    discount = n.pct(F.col("d"), F.col("dn"))
    return sums.select(
        "segment",
        margin.alias("margin"),
        n.pct_text(margin).alias("margin_text"),
        discount.alias("avg_discount"),
        n.pct_text(discount).alias("avg_discount_text"),
    )


@metric("customer_name", "segment", "sales", "order_id", "profit", summed=True)
def top_customers(df: DataFrame, k: int = 10) -> DataFrame:
    sums = known(df, "customer_name", "segment").groupBy("customer_name", "segment").agg(
        n.total(F.col("sales")).alias("r"),
        F.count_distinct("order_id").alias("orders"),
        n.total(F.col("profit")).alias("p"),
    )
    best = sums.orderBy(F.desc("r"), "customer_name", "segment").limit(k)
    # k rows from here on
    rank = F.row_number().over(Window.orderBy(F.desc("r"), "customer_name", "segment"))
    ticket = n.ratio(F.col("r"), F.col("orders"))
    return best.select(
        rank.cast("bigint").alias("rank"),
        F.col("customer_name").alias("name"),
        "segment",
        n.real(F.col("r")).alias("revenue"),
        n.money_short(F.col("r")).alias("revenue_fmt"),
        "orders",
        ticket.alias("ticket"),
        n.money_short(ticket).alias("ticket_fmt"),
        n.pct(F.col("p"), F.col("r")).alias("margin"),
        n.margin_band(n.pct(F.col("p"), F.col("r"))).alias("band"),
    )


@metric("customer_name", "segment", "sales", "order_id", summed=True)
def insight(df: DataFrame) -> DataFrame:
    """Top segment, mean ticket, customers and repeat rate; no row without data.

    Customer, segment and grand totals come from one read through grouping
    sets, each with its exact distinct order count.
    """
    name, segment = F.col("customer_name"), F.col("segment")
    levels = df.groupingSets([[name, segment], [segment], []], name, segment).agg(
        F.grouping_id("customer_name", "segment").alias("_level"),
        n.total(F.col("sales")).alias("r"),
        F.count_distinct("order_id").alias("orders"),
    )
    customer, by_segment, overall = (F.col("_level") == i for i in (0, 2, 3))
    # min over (-revenue, name): largest revenue, then first name
    leader = F.min(F.when(by_segment & segment.isNotNull(), F.struct((-F.col("r")).alias("m"), segment.alias("s"))))
    summary = levels.agg(
        leader.alias("lead"),
        F.max(F.when(overall, F.col("r"))).alias("r"),
        F.max(F.when(overall, F.col("orders"))).alias("orders"),
        F.count_distinct(F.when(customer, name)).alias("total_customers"),
        F.count(F.when(customer & (F.col("orders") > 1), 1)).alias("repeaters"),
        F.count(F.when(customer, 1)).alias("pairs"),
    )
    return summary.filter(F.col("lead").isNotNull()).select(
        F.col("lead.s").alias("top_segment"),
        n.money_short(-F.col("lead.m")).alias("top_revenue"),
        n.money_short(F.coalesce(n.ratio(F.col("r"), F.col("orders")), F.lit(0.0))).alias("avg_ticket"),
        "total_customers",
        n.pct_or_zero(F.col("repeaters"), F.col("pairs")).alias("repeat_rate"),
    )


@metric("customer_name", "order_id", summed=True)
def frequency(df: DataFrame) -> DataFrame:
    """Customers per number of orders; the last bin is open."""
    orders = known(df, "customer_name").groupBy("customer_name").agg(F.count_distinct("order_id").alias("orders"))

    def inside(low, high, label):
        test = F.col("orders") >= low
        return test if high is None else test & (F.col("orders") <= high)

    wide = orders.agg(
        *[F.count(F.when(inside(*b), 1)).alias(f"n{i}") for i, b in enumerate(FREQUENCY_BINS)]
    )
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i + 1).alias("ordinal"), F.lit(b[2]).alias("orders_range"), F.col(f"n{i}").alias("customers")
                    )
                    for i, b in enumerate(FREQUENCY_BINS)
                ]
            )
        )
    )
