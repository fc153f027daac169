"""Headline figures, year-over-year comparison, alerts, top products."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillstar.functions import numbers as n
from tillstar.operators.metric import compute, known, metric
from tillstar.operators.slices import ALL, Slice


@metric("sales", "profit", "order_id", "customer_name", "quantity", summed=True)
def kpis(df: DataFrame) -> DataFrame:
    sums = df.agg(
        n.total(F.col("sales")).alias("sales"),
        n.total(F.col("profit")).alias("profit"),
        F.count_distinct("order_id").alias("total_orders"),
        F.count_distinct("customer_name").alias("total_customers"),
        n.total(F.col("quantity")).alias("total_units"),
        n.total(F.when(F.col("order_id").isNotNull(), F.col("quantity"))).alias("_ordered_units"),
    )
    return sums.select(
        n.real(F.col("sales")).alias("total_sales"),
        n.money_short(F.col("sales")).alias("total_sales_fmt"),
        n.real(F.col("profit")).alias("total_profit"),
        n.money_short(F.col("profit")).alias("total_profit_fmt"),
        "total_orders",
        "total_customers",
        n.pct_or_zero(F.col("profit"), F.col("sales")).alias("margin"),
        "total_units",
        F.bround(n.ratio(F.col("_ordered_units"), F.col("total_orders")), 1).alias("avg_qty_per_order"),
    )


@metric("order_id", "lines", summed=True)
def fact_rows(df: DataFrame) -> DataFrame:
    """Lines with an order, as ``total_fact_rows``."""
    return df.filter(F.col("order_id").isNotNull()).agg(n.total(F.col("lines")).alias("total_fact_rows"))


def headline(source, within: Slice = Slice()) -> DataFrame:
    """The figures of a slice beside the number of all lines."""
    one = F.lit(1)
    figures, rows = compute(kpis, source, within), compute(fact_rows, source)
    return figures.withColumn("_one", one).join(rows.withColumn("_one", one), "_one").drop("_one")


def year_on_year(source, within: Slice = Slice(), mode: str = "latest_vs_previous") -> DataFrame:
    """``kpi_yoy`` of a source. With a year in the slice only that year and the
    one before are read, and only the slice's region and segment; without one,
    the years of the whole decide."""
    if not within.has_year:
        return kpi_yoy(source.view(*kpi_yoy.columns, summed=True), within, mode)
    year = int(within.year)
    members = Slice(region=within.region, segment=within.segment)
    days = F.col("order_date").between(F.lit(dt.date(year - 1, 1, 1)), F.lit(dt.date(year, 12, 31)))
    return kpi_yoy(members.apply(source.view(*kpi_yoy.columns)).filter(days), within, mode)


@metric("order_date", "sales", "profit", "order_id", "region", "segment", summed=True)
def kpi_yoy(df: DataFrame, within: Slice = Slice(), mode: str = "latest_vs_previous") -> DataFrame:
    """Slice figures against those of the previous year.

    ``df`` is the whole view: the years present decide what "previous" means,
    the region and segment of ``within`` apply inside the aggregates, and its
    year picks the current one. Without a year, ``latest_vs_previous`` compares
    the two latest years, ``reference`` all years with the second latest.
    """
    inside = Slice(region=within.region, segment=within.segment).condition()
    measures = {
        "sales": n.total(F.when(F.col("_in"), F.col("sales"))),
        "profit": n.total(F.when(F.col("_in"), F.col("profit"))),
        "orders": F.count_distinct(F.when(F.col("_in"), F.col("order_id"))),
    }
    by_year = (
        df.withColumns({"_in": inside, "year": F.year("order_date")})
        .rollup("year")
        .agg(F.grouping("year").alias("_all"), *[m.alias(k) for k, m in measures.items()])
    )
    # one row per calendar year, plus the total
    newest = Window.partitionBy("_all").orderBy(F.desc_nulls_last("year"))
    ranked = by_year.withColumn("_rank", F.row_number().over(newest))
    single = F.col("_all") == 0
    if within.has_year:
        is_now = single & (F.col("year") == int(within.year))
        is_before = single & (F.col("year") == int(within.year) - 1)
    else:
        is_now = F.col("_all") == 1 if mode == "reference" else single & (F.col("_rank") == 1)
        is_before = single & (F.col("_rank") == 2)
    pairs = ranked.agg(
        *[n.total(F.when(is_now, F.col(k))).alias(k) for k in measures],
        *[n.total(F.when(is_before, F.col(k))).alias(f"prev_{k}") for k in measures],
    )
    rated = pairs.withColumns(
        {
            "margin": n.pct_or_zero(F.col("profit"), F.col("sales")),
            "prev_margin": n.pct_or_zero(F.col("prev_profit"), F.col("prev_sales")),
            **{f"yoy_{k}": n.change_pct(F.col(k), F.col(f"prev_{k}")) for k in measures},
        }
    )
    yoy_margin = F.bround(F.col("margin") - F.col("prev_margin"), 1)
    return rated.select(
        n.real(F.col("sales")).alias("sales"),
        n.real(F.col("prev_sales")).alias("prev_sales"),
        "yoy_sales",
        n.trend_sign(F.col("yoy_sales")).alias("sales_trend"),
        n.real(F.col("profit")).alias("profit"),
        n.real(F.col("prev_profit")).alias("prev_profit"),
        "yoy_profit",
        n.trend_sign(F.col("yoy_profit")).alias("profit_trend"),
        F.col("orders").cast("bigint").alias("orders"),
        F.col("prev_orders").cast("bigint").alias("prev_orders"),
        "yoy_orders",
        n.trend_sign(F.col("yoy_orders")).alias("orders_trend"),
        "margin",
        "prev_margin",
        yoy_margin.alias("yoy_margin"),
        n.trend_sign(yoy_margin).alias("margin_trend"),
    )


# The members and the discount the alerts watch.
ALERT_REGION = "South"
ALERT_CATEGORY = "Technology"
ALERT_DISCOUNT = 0.5


@metric("order_date", "region", "segment", "category", "discount", "sales", "profit")
def alerts(
    df: DataFrame,
    within: Slice = Slice(),
    threshold: float = ALERT_DISCOUNT,
    region: str = ALERT_REGION,
    category: str = ALERT_CATEGORY,
) -> DataFrame:
    """Loss on high discounts, margin of one region, margin of one category.

    Each figure has its own scope over the whole view ``df``: the slice itself,
    the slice with its region replaced, the slice without its segment.
    """
    scopes = {
        "_loss": within.condition() & (F.col("discount") > F.lit(threshold)),
        "_region": Slice(region, within.year, within.segment).condition(),
        "_category": Slice(within.region, within.year, ALL).condition() & (F.col("category") == category),
    }
    # the scopes share the year; lines outside all of them are not read further
    read = Slice(year=within.year).apply(df).withColumns(scopes).filter(F.col("_loss") | F.col("_region") | F.col("_category"))
    sums = read.agg(
        n.total(F.when(F.col("_loss"), F.col("profit"))).alias("loss"),
        *[
            F.sum(F.when(F.col(scope), F.col(m))).alias(f"{scope}_{m}")
            for scope in ("_region", "_category")
            for m in ("sales", "profit")
        ],
    )
    region_margin = n.pct_or_zero(F.col("_region_profit"), F.col("_region_sales"))
    return sums.select(
        n.real(F.col("loss")).alias("discount_loss"),
        n.money_short(F.col("loss")).alias("discount_loss_fmt"),
        F.when(F.col("loss") < 0, "red").otherwise("green").alias("discount_band"),
        region_margin.alias("region_margin"),
        n.region_margin_band(region_margin).alias("region_band"),
        n.pct_or_zero(F.col("_category_profit"), F.col("_category_sales")).alias("category_margin"),
    )


@metric("order_id", "quantity", summed=True)
def quantity_stats(df: DataFrame) -> DataFrame:
    """Units sold, and the mean over orders of the units per order.

    The mean of per-order sums is the sum over the number of orders, so no
    aggregation to order level is needed.
    """
    sums = df.agg(
        n.total(F.col("quantity")).alias("total_units"),
        n.total(F.when(F.col("order_id").isNotNull(), F.col("quantity"))).alias("_ordered"),
        F.count_distinct("order_id").alias("_orders"),
    )
    return sums.select(
        "total_units", F.bround(n.ratio(F.col("_ordered"), F.col("_orders")), 1).alias("avg_per_order")
    )


@metric("category", "quantity", summed=True)
def units_by_category(df: DataFrame) -> DataFrame:
    return known(df, "category").groupBy("category").agg(n.total(F.col("quantity")).alias("units"))


@metric("product_name", "category", "sales", "profit", summed=True)
def top_products(df: DataFrame, k: int = 5) -> DataFrame:
    sums = known(df, "product_name", "category").groupBy("product_name", "category").agg(
        n.total(F.col("sales")).alias("revenue"), n.total(F.col("profit")).alias("profit")
    )
    best = sums.orderBy(F.desc("revenue"), "product_name", "category").limit(k)
    return best.select(
        F.col("product_name").alias("name"),
        "category",
        n.real(F.col("revenue")).alias("revenue"),
        n.money_short(F.col("revenue")).alias("revenue_fmt"),
        n.real(F.col("profit")).alias("profit"),
        n.pct_or_zero(F.col("profit"), F.col("revenue")).alias("margin"),
    )


@metric("order_id", "region", "order_date", "segment", "lines", summed=True)
def filter_coverage(df: DataFrame, within: Slice = Slice()) -> DataFrame:
    """Distinct orders of the slice beside all fact rows, from one pass."""
    counts = df.agg(
        F.count_distinct(F.when(within.condition(), F.col("order_id"))).alias("filtered_orders"),
        n.total(F.when(F.col("order_id").isNotNull(), F.col("lines"))).alias("total_fact_rows"),
    )
    return counts.withColumn(
        "coverage_pct", n.pct_or_zero(F.col("filtered_orders"), F.col("total_fact_rows"))
    )


@metric("region", "order_date", "segment", "lines", summed=True)
def filter_values(df: DataFrame) -> DataFrame:
    """Choices of each filter, the "all" word first, with fact rows per choice.

    The fact is counted once per (region, year, segment) cell; the three lists
    are rolled up from those cells.
    """
    cells = df.groupBy(
        F.col("region"), F.year("order_date").cast("string").alias("year"), F.col("segment")
    ).agg(n.total(F.col("lines")).alias("rows"))
    all_words = {"region": "Todas", "year": ALL, "segment": ALL}
    choices = cells.select(
        "rows",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(kind).alias("filter_name"),
                        F.lit(order).alias("ordinal"),
                        (F.lit(word) if order == 0 else F.col(kind)).alias("value"),
                    )
                    for kind, word in all_words.items()
                    for order in (0, 1)
                ]
            )
        ).alias("c"),
    )
    return (
        choices.filter(F.col("c.value").isNotNull())
        .groupBy("c.filter_name", "c.ordinal", "c.value")
        .agg(F.sum("rows").alias("fact_rows"))
        .orderBy("filter_name", "ordinal", "value")
    )
