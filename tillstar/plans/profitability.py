"""Profit by discount, by region and category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstar.functions import numbers as n
from tillstar.operators.metric import known, metric


@metric("discount", "profit", "sales")
def discount_tiers(df: DataFrame, cuts=n.DISCOUNT_CUTS, labels=n.TIER_LABELS) -> DataFrame:
    """Transactions and profit per tier, in tier order, 0 for an empty tier.

    One conditional aggregate per tier instead of a join with the tier list:
    every tier is there by construction and a single row is shuffled per task.
    """
    tiered = df.withColumn("_tier", n.discount_tier(F.col("discount"), cuts, labels))
    wide = tiered.agg(
        *[F.count(F.when(F.col("_tier") == tier, F.col("sales"))).alias(f"n{i}") for i, tier in enumerate(labels)],
        *[n.total(F.when(F.col("_tier") == tier, F.col("profit"))).alias(f"p{i}") for i, tier in enumerate(labels)],
    )
    rows = wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i + 1).alias("ordinal"),
                        F.lit(tier).alias("tier"),
                        F.col(f"n{i}").alias("transactions"),
                        F.col(f"p{i}").alias("profit"),
                    )
                    for i, tier in enumerate(labels)
                ]
            )
        )
    )
    return rows.select(
        "ordinal",
        "tier",
        "transactions",
        n.real(F.col("profit")).alias("profit"),
        n.money_short(F.col("profit")).alias("profit_fmt"),
        n.trend_sign(F.col("profit")).alias("profit_sign"),
    )


@metric("discount", "profit")
def discount_loss(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Profit on lines above the threshold and their share of all lines."""
    high = F.col("discount") > F.lit(threshold)
    sums = df.agg(
        n.total(F.when(high, F.col("profit"))).alias("loss"),
        F.count(F.when(high, 1)).alias("transactions"),
        F.count(F.lit(1)).alias("lines"),
    )
    return sums.select(
        n.real(F.col("loss")).alias("discount_loss"),
        n.money_short(F.col("loss")).alias("discount_loss_fmt"),
        "transactions",
        n.pct_or_zero(F.col("transactions"), F.col("lines")).alias("discount_pct"),
    )


@metric("region", "category", "profit", summed=True)
def by_region_category(df: DataFrame) -> DataFrame:
    sums = known(df, "region", "category").groupBy("region", "category").agg(n.total(F.col("profit")).alias("p"))
    return sums.orderBy(F.desc("p"), "region", "category").select(
        "region", "category", n.real(F.col("p")).alias("profit")
    )


@metric("region", "category", "profit", summed=True)
def winner(df: DataFrame) -> DataFrame:
    """The most profitable region and category pair."""
    return by_region_category(df).limit(1).withColumn("profit_fmt", n.money_short(F.col("profit")))


@metric("region", "category", "segment", "profit", summed=True)
def heatmap(df: DataFrame) -> DataFrame:
    """Profit per region (rows) and category (columns, as a long frame)."""
    cells = known(df, "region", "category", "segment").groupBy("region", "category")
    return cells.agg(n.real(n.total(F.col("profit"))).alias("profit"))


def heatmap_wide(cells: DataFrame, categories: list[str]) -> DataFrame:
    """The heatmap with one column per named category."""
    return cells.groupBy("region").pivot("category", categories).agg(F.sum("profit")).fillna(0.0)


@metric("product_name", "region", "segment", "sales", "profit", "order_date", "ship_date")
def status_bands(df: DataFrame, on_time_days: int = 5) -> DataFrame:
    """Traffic-light bands of product, region and segment margins and of on-time shares.

    Grouping sets give all three levels from one read of the view.
    """
    late = F.datediff("ship_date", "order_date")
    levels = (
        df.withColumn("_days", late)
        .groupingSets(
            [[F.col("product_name")], [F.col("region")], [F.col("segment")]],
            F.col("product_name"),
            F.col("region"),
            F.col("segment"),
        )
        .agg(
            F.grouping_id("product_name", "region", "segment").alias("_level"),
            F.sum("sales").alias("s"),
            F.sum("profit").alias("p"),
            F.count(F.when(F.col("_days") <= on_time_days, 1)).alias("on_time"),
            F.count("_days").alias("shipped"),
        )
    )
    product, region, segment = (F.col("_level") == i for i in (3, 5, 6))
    margin = n.pct_or_zero(F.col("p"), F.col("s"))
    share = n.pct_or_zero(F.col("on_time"), F.col("shipped"))
    checks = [
        ("product_margin", product, "product_name", margin, n.margin_band(margin)),
        ("region_margin", region, "region", margin, n.region_margin_band(margin)),
        ("region_on_time", region, "region", share, n.on_time_band(share)),
        ("segment_margin", segment, "segment", margin, n.segment_margin_band(margin)),
    ]
    each = F.array(
        *[
            F.when(
                test,
                F.struct(F.lit(name).alias("measure"), F.col(who).alias("member"), value.alias("value"), band.alias("band")),
            )
            for name, test, who, value, band in checks
        ]
    )
    return levels.select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("r")).select("r.*")

