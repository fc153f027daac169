"""Exports: filtered rows as CSV, and one dataset per report sheet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillstar.functions import numbers as n
from tillstar.operators.metric import compute
from tillstar.operators.slices import Slice
from tillstar.plans import customers, overview, pareto, profitability, sales, shipping, timeline
from tillstar.schemas import VIEW_COLUMNS
from tillstar.sources.tables import as_reported


def export_rows(source, within: Slice = Slice()) -> DataFrame:
    """The flat view of a slice, one row per order line."""
    return as_reported(within.apply(source.view(*VIEW_COLUMNS)))


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(folder)


def _cents(*columns: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({c: F.bround(c, 2) for c in columns})


def _indicators(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row of figures as (indicator, value) rows."""
    return df.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(label).alias("indicator"), n.real(F.col(c)).alias("value"))
                    for c, label in names.items()
                ]
            )
        )
    )


def _ranked(df: DataFrame, by: str, *ties: str) -> DataFrame:
    """Number the few rows of a top-k list."""
    place = F.row_number().over(Window.orderBy(F.desc(by), *ties))
    return df.select(place.alias("rank"), "*")


def sheets(source, module: str, within: Slice = Slice(), cuts=n.DISCOUNT_CUTS, labels=n.TIER_LABELS, threshold: float = 0.5) -> dict[str, DataFrame]:
    """Sheet name -> frame for one report module.

    ``cuts`` and ``labels`` are the discount tiers, ``threshold`` the discount
    above which a line counts as a loss by discount.
    """

    def run(function, **options):
        return compute(function, source, within, **options)

    def overview_sheets():
        headline = _cents("total_sales", "total_profit")(run(overview.kpis))
        return {
            "kpis": _indicators(
                headline,
                {  # fixed values: labels of the figures, here and below
                    "total_sales": "Ingresos Totales",
                    "total_profit": "Utilidad Total",
                    "total_orders": "Ordenes",
                    "total_customers": "Clientes",
                    "margin": "Margen %",
                    "total_units": "Unidades Vendidas",
                },
            ),
            "top_products": _cents("revenue", "profit")(run(overview.top_products)).drop("revenue_fmt"),
            "pareto": run(pareto.products)
            .orderBy("position")
            .limit(20)
            .withColumns(
                {
                    "revenue": F.bround("revenue", 2),
                    "cum_pct": F.bround("cum_pct", 1),
                    "product_pct": F.bround("product_pct", 1),
                }
            ),
            "monthly": run(timeline.mom_change).select(
                "month", F.bround("sales", 2).alias("sales"), F.bround("mom_pct", 1).alias("mom_pct")
            ),
        }

    def sales_sheets():
        top = _cents("sales", "profit")(run(sales.top_products)).drop("sales_fmt", "profit_fmt", "band")
        cents = _cents("sales")
        return {
            "top_products": _ranked(top, "sales", "product_name", "category", "sub_category"),
            "by_category": cents(run(sales.by_category)).drop("sales_fmt"),
            "by_region": cents(run(sales.by_region)).drop("sales_fmt"),
            "monthly": run(timeline.mom_change).select("month", F.bround("sales", 2).alias("sales")),
            "by_subcategory": cents(run(sales.by_subcategory)).drop("sales_fmt"),
            "by_city": cents(run(sales.by_city)).select("city", "state", "sales"),
        }

    def profitability_sheets():
        return {
            "discount_tiers": _cents("profit")(run(profitability.discount_tiers, cuts=cuts, labels=labels)).select(
                "tier", "transactions", "profit"
            ),
            "discount_loss": _indicators(
                _cents("discount_loss")(run(profitability.discount_loss, threshold=threshold)),
                {"discount_loss": "Perdida desc. agresivos", "discount_pct": "% transacciones >50% desc."},
            ),
            "region_category": _cents("profit")(run(profitability.by_region_category)),
        }

    def customers_sheets():
        return {
            "segments": _cents("revenue", "avg_order")(run(customers.segment_cards)).drop(
                "revenue_fmt", "avg_order_fmt", "band"
            ),
            "top_customers": _cents("revenue", "ticket")(run(customers.top_customers)).drop(
                "revenue_fmt", "ticket_fmt", "band"
            ),
            "frequency": run(customers.frequency).drop("ordinal"),
        }

    def shipping_sheets():
        return {
            "general": _indicators(
                run(shipping.stats),
                {
                    "avg_delivery_days": "Dias de entrega promedio",
                    "on_time_pct": "% a tiempo (≤5 dias)",
                    "total_orders": "Total ordenes enviadas",
                },
            ),
            "by_region": run(shipping.kpis_by_region).drop("band"),
            "by_mode": _cents("revenue", "profit")(run(shipping.mode_impact)).drop("revenue_fmt", "profit_fmt"),
        }

    modules = {
        "overview": overview_sheets,
        "sales": sales_sheets,
        "profitability": profitability_sheets,
        "customers": customers_sheets,
        "shipping": shipping_sheets,
    }
    if module not in modules:
        raise KeyError(f"no export module {module!r}; known: {sorted(modules)}")
    return modules[module]()


def export_module(source, module: str, folder: str, within: Slice = Slice(), fmt: str = "csv", **options) -> list[str]:
    """Write each sheet of a module under ``folder/module/sheet``; ``options`` are those of ``sheets``."""
    written = []
    for name, df in sheets(source, module, within, **options).items():
        path = f"{folder.rstrip('/')}/{module}/{name}"
        df.write.mode("overwrite").format(fmt).options(**({"header": True} if fmt == "csv" else {})).save(path)
        written.append(path)
    return written
