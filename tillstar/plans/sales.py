"""Sales by category, region, segment, product and place."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstar.functions import numbers as n
from tillstar.operators.metric import known, metric

# Postal abbreviations of the states on the map.
STATE_ABBREVIATIONS = {
    "Alabama": "AL", "Arizona": "AZ", "Arkansas": "AR", "California": "CA", "Colorado": "CO",
    "Connecticut": "CT", "Delaware": "DE", "District of Columbia": "DC", "Florida": "FL",
    "Georgia": "GA", "Idaho": "ID", "Illinois": "IL", "Indiana": "IN", "Iowa": "IA", "Kansas": "KS",
    "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD", "Massachusetts": "MA",
    "Michigan": "MI", "Minnesota": "MN", "Mississippi": "MS", "Missouri": "MO", "Montana": "MT",
    "Nebraska": "NE", "Nevada": "NV", "New Hampshire": "NH", "New Jersey": "NJ", "New Mexico": "NM",
    "New York": "NY", "North Carolina": "NC", "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK",
    "Oregon": "OR", "Pennsylvania": "PA", "Rhode Island": "RI", "South Carolina": "SC",
    "South Dakota": "SD", "Tennessee": "TN", "Texas": "TX", "Utah": "UT", "Vermont": "VT",
    "Virginia": "VA", "Washington": "WA", "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY",
}


def state_lookup(spark: SparkSession) -> DataFrame:
    """The abbreviations as a (state, abbr) frame."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(STATE_ABBREVIATIONS.items())])
    return spark.range(1).select(F.explode(pairs).alias("state", "abbr"))


def _ranked_sales(df: DataFrame, *keys: str, k: int | None = None) -> DataFrame:
    sums = known(df, *keys).groupBy(*keys).agg(n.total(F.col("sales")).alias("sales"))
    ordered = sums.orderBy(F.desc("sales"), *keys)
    if k is not None:
        ordered = ordered.limit(k)
    return ordered.select(
        *keys, n.real(F.col("sales")).alias("sales"), n.money_short(F.col("sales")).alias("sales_fmt")
    )


@metric("category", "sales", summed=True)
def by_category(df: DataFrame) -> DataFrame:
    return _ranked_sales(df, "category")


@metric("region", "sales", summed=True)
def by_region(df: DataFrame) -> DataFrame:
    return _ranked_sales(df, "region")


@metric("segment", "sales", summed=True)
def by_segment(df: DataFrame) -> DataFrame:
    return _ranked_sales(df, "segment")


@metric("sub_category", "sales", summed=True)
def by_subcategory(df: DataFrame, k: int = 15) -> DataFrame:
    return _ranked_sales(df, "sub_category", k=k)


@metric("state", "city", "sales", summed=True)
def by_city(df: DataFrame, k: int = 15) -> DataFrame:
    return _ranked_sales(df, "state", "city", k=k).withColumn("location", F.concat_ws(", ", "city", "state"))


@metric("state", "sales", "profit", summed=True)
def by_state(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """Sales and profit of the states the lookup knows; the rest is dropped."""
    sums = known(df, "state").groupBy("state").agg(
        n.total(F.col("sales")).alias("sales"), n.total(F.col("profit")).alias("profit")
    )
    return sums.join(lookup, "state").select(
        "state",
        "abbr",
        n.real(F.col("sales")).alias("sales"),
        n.real(F.col("profit")).alias("profit"),
    )


@metric("product_name", "category", "sub_category", "sales", "profit", summed=True)
def top_products(df: DataFrame, k: int = 10) -> DataFrame:
    sums = known(df, "product_name", "category", "sub_category").groupBy("product_name", "category", "sub_category").agg(
        n.total(F.col("sales")).alias("sales"), n.total(F.col("profit")).alias("profit")
    )
    best = sums.orderBy(F.desc("sales"), "product_name", "category", "sub_category").limit(k)
    margin = n.pct(F.col("profit"), F.col("sales"))
    return best.select(
        "product_name",
        "category",
        "sub_category",
        n.real(F.col("sales")).alias("sales"),
        n.money_short(F.col("sales")).alias("sales_fmt"),
        n.real(F.col("profit")).alias("profit"),
        n.money_short(F.col("profit")).alias("profit_fmt"),
        margin.alias("margin"),
        n.margin_band(margin).alias("band"),
    )


# ---- the three analytic queries over the star -------------------------------


@metric("region", "category", "sales", "profit", "order_id")
def region_category(df: DataFrame) -> DataFrame:
    """Sales, profit and distinct orders by region and category."""
    sums = df.groupBy("region", "category").agg(
        F.sum("sales").alias("s"), F.sum("profit").alias("p"), F.count_distinct("order_id").alias("order_count")
    )
    return sums.orderBy(F.desc("s"), "region", "category").select(
        "region",
        "category",
        n.real(F.col("s")).alias("total_sales"),
        n.real(F.col("p")).alias("total_profit"),
        "order_count",
    )


@metric("product_name", "sub_category", "sales", "profit", summed=True)
def most_profitable_products(df: DataFrame, k: int = 10) -> DataFrame:
    sums = df.groupBy("product_name", "sub_category").agg(F.sum("sales").alias("s"), F.sum("profit").alias("p"))
    best = sums.orderBy(F.desc("p"), "product_name", "sub_category").limit(k)
    return best.select(
        "product_name",
        "sub_category",
        n.real(F.col("s")).alias("total_sales"),
        n.real(F.col("p")).alias("total_profit"),
        (n.ratio(F.col("p"), F.col("s")) * 100).alias("margin_pct"),
    )


@metric("discount", "sales", "profit")
def discount_impact(df: DataFrame, cuts=n.DISCOUNT_CUTS, labels=n.TIER_LABELS_LONG) -> DataFrame:
    tiered = df.withColumn("discount_tier", n.discount_tier(F.col("discount"), cuts, labels))
    sums = tiered.groupBy("discount_tier").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum("sales").alias("s"),
        F.sum("profit").alias("p"),
        F.sum("discount").alias("d"),
        F.count("discount").alias("dn"),
    )
    return sums.select(
        "discount_tier",
        "transactions",
        n.real(F.col("s")).alias("total_sales"),
        n.real(F.col("p")).alias("total_profit"),
        n.ratio(F.col("d"), F.col("dn")).alias("avg_discount"),
    ).orderBy("avg_discount")
