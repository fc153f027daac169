"""Dimensions, fact and monthly aggregate of the star."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillstar.functions import numbers as n
from tillstar.functions.text import raw_date, squeeze
from tillstar.operators.distinct import distinct_cells, roll_up
from tillstar.operators.history import apply_versions, current, first_versions
from tillstar.operators.keyed import first_per_key, last_key, lookup_key
from tillstar.operators.metric import compute, metric
from tillstar.operators.ordered import with_dense_key
from tillstar.operators.quality import duplicate_report, orphan_report
from tillstar.operators.slices import Slice
from tillstar.session import settle

CUSTOMER = ("customer_name", "segment")
PRODUCT = ("product_name", "category", "sub_category")
LOCATION = ("country", "region", "state", "city", "postal_code")
CLEANED_TEXT = ("customer_name", "product_name", "city", "state", "country")


# ---- cleaning ---------------------------------------------------------------


def clean(raw: DataFrame, strict: bool = False) -> DataFrame:
    """Parse both dates, drop lines without them, normalise the text columns present."""
    dates = {c: raw_date(F.col(c), strict) for c in ("order_date", "ship_date")}
    texts = {c: squeeze(F.col(c)) for c in CLEANED_TEXT if c in raw.columns}
    return raw.withColumns(dates).dropna(subset=list(dates)).withColumns(texts)


@metric("profit", "discount")
def profile(df: DataFrame) -> DataFrame:
    """Loss-making lines, largest discount, smallest profit."""
    sums = df.agg(
        F.count(F.when(F.col("profit") < 0, 1)).alias("loss_lines"),
        F.count(F.lit(1)).alias("lines"),
        F.max("discount").alias("d"),
        F.min("profit").alias("p"),
    )
    return sums.select(
        "loss_lines",
        n.pct_or_zero(F.col("loss_lines"), F.col("lines")).alias("loss_pct"),
        n.real(F.col("d")).alias("max_discount"),
        n.pct_text(F.col("d") * 100, 0).alias("max_discount_text"),
        n.real(F.col("p")).alias("min_profit"),
        n.money(F.col("p"), 2).alias("min_profit_text"),
    )


# ---- dimensions -------------------------------------------------------------


@metric("order_date", "ship_date")
def d_date(df: DataFrame) -> DataFrame:
    """Every day an order was placed or shipped, numbered by date."""
    # one pass: both dates of a line become rows, combined on the map side
    days = (
        df.select(F.explode(F.array("order_date", "ship_date")).alias("date"))
        .filter(F.col("date").isNotNull())
        .select(F.to_date("date").alias("date"))
        .distinct()
    )
    # at most one row per calendar day
    number = F.row_number().over(Window.orderBy("date")).cast("bigint")
    return days.select(
        number.alias("date_sk"),
        "date",
        F.dayofmonth("date").alias("day"),
        F.month("date").alias("month"),
        F.date_format("date", "MMMM").alias("month_name"),
        F.quarter("date").alias("quarter"),
        F.year("date").alias("year"),
        F.date_format("date", "EEEE").alias("week_day"),
        (F.weekday("date") >= 5).alias("is_weekend"),
    )


def customers_of(df: DataFrame, arrival: str = "order_id") -> DataFrame:
    return first_per_key(df, ["customer_id"], CUSTOMER, arrival)


def products_of(df: DataFrame, arrival: str = "order_id") -> DataFrame:
    return first_per_key(df, ["product_id"], PRODUCT, arrival)


@metric("customer_id", "customer_name", "segment", "order_id", summed=True)
def d_customer(df: DataFrame, run_date: dt.date, arrival: str = "order_id") -> DataFrame:
    return first_versions(customers_of(df, arrival), "customer_sk", "customer_id", CUSTOMER, run_date)


@metric("product_id", "product_name", "category", "sub_category", "order_id")
def d_product(df: DataFrame, run_date: dt.date, arrival: str = "order_id") -> DataFrame:
    return first_versions(products_of(df, arrival), "product_sk", "product_id", PRODUCT, run_date)


@metric("country", "region", "state", "city", "postal_code", summed=True)
def d_location(df: DataFrame) -> DataFrame:
    return with_dense_key(df.select(*LOCATION).distinct(), "location_sk", LOCATION)


@metric("order_id", "ship_mode", summed=True)
def d_order(df: DataFrame, arrival: str | None = None) -> DataFrame:
    """One row per order; the first ship mode in ``arrival`` order if lines disagree."""
    if arrival is None:
        # distinct pairs first: a hash aggregate with a map-side combine
        pairs = df.select("order_id", "ship_mode").distinct()
        return pairs.groupBy("order_id").agg(F.min("ship_mode").alias("ship_mode"))
    return first_per_key(df, ["order_id"], ["ship_mode"], arrival)


@metric("segment", summed=True)
def d_segment(df: DataFrame) -> DataFrame:
    names = df.filter(F.col("segment").isNotNull()).select(F.col("segment").alias("segment_name")).distinct()
    return with_dense_key(names, "segment_sk", ["segment_name"])


# ---- fact -------------------------------------------------------------------

FLAT_COLUMNS = (
    "order_id", "order_date", "ship_date", "ship_mode", "customer_id", "product_id",
    "city", "state", "sales", "quantity", "discount", "profit",
)


def f_sales(flat: DataFrame, dims: Mapping[str, DataFrame], unknown: int = 1) -> DataFrame:
    """Replace business keys by surrogates; an unknown key becomes ``unknown``.

    Several locations may share a city and state: the largest surrogate wins.
    ``order_year`` is the year of the date member found, the partition column.
    """
    days = dims["d_date"].select("date", "date_sk")
    years = dims["d_date"].select(F.col("date_sk").alias("order_date_sk"), F.col("year").alias("order_year"))
    people = current(dims["d_customer"])
    goods = current(dims["d_product"])
    places = last_key(dims["d_location"], ["city", "state"], "location_sk")
    keyed = lookup_key(flat, days, {"order_date": "date"}, "date_sk", "order_date_sk", unknown)
    keyed = lookup_key(keyed, days, {"ship_date": "date"}, "date_sk", "ship_date_sk", unknown)
    keyed = keyed.join(years, "order_date_sk", "left")
    # what shrinks a line first, and products while lines may still lie by product
    keyed = lookup_key(keyed, places, {"city": "city", "state": "state"}, "location_sk", unknown=unknown).drop("city", "state")
    keyed = lookup_key(keyed, goods, {"product_id": "product_id"}, "product_sk", unknown=unknown)
    keyed = lookup_key(keyed, people, {"customer_id": "customer_id"}, "customer_sk", unknown=unknown)
    return keyed.select(
        "order_date_sk", "ship_date_sk", "customer_sk", "product_sk", "location_sk",
        "order_id", "ship_mode", "sales", "quantity", "discount", "profit",
        "order_year",
    )


def build_star(source, run_date: dt.date) -> dict[str, DataFrame]:
    """All dimensions and the fact from a source with ``view``.

    Each dimension reads its few columns of the source and is written out; the
    lines themselves are only read, for the fact. The dimensions are
    independent, so they are built side by side; their true file size then
    decides between broadcast and shuffle joins.
    """
    builders = {
        "d_date": lambda: compute(d_date, source),
        "d_customer": lambda: compute(d_customer, source, run_date=run_date),
        "d_product": lambda: compute(d_product, source, run_date=run_date),
        "d_location": lambda: compute(d_location, source),
        "d_order": lambda: compute(d_order, source),
        "d_segment": lambda: compute(d_segment, source),
    }
    with ThreadPoolExecutor(len(builders)) as pool:
        # each in a copy of this context, which knows who deletes the files
        contexts = [copy_context() for _ in builders]
        built = pool.map(lambda item, context: (item[0], context.run(lambda: settle(item[1](), item[0]))), builders.items(), contexts)
        dims = dict(built)
    return {**dims, "f_sales": f_sales(source.view(*FLAT_COLUMNS), dims)}


# ---- keys and constraints -----------------------------------------------------

PRIMARY_KEYS = {
    "d_date": ("date_sk",),
    "d_customer": ("customer_sk",),
    "d_product": ("product_sk",),
    "d_location": ("location_sk",),
    "d_order": ("order_id",),
    "d_segment": ("segment_sk",),
    "f_sales": ("order_date_sk", "customer_sk", "product_sk", "location_sk"),
}

FOREIGN_KEYS = {
    "sales_order_date": ("order_date_sk", "d_date", "date_sk"),
    "sales_ship_date": ("ship_date_sk", "d_date", "date_sk"),
    "sales_customer": ("customer_sk", "d_customer", "customer_sk"),
    "sales_product": ("product_sk", "d_product", "product_sk"),
    "sales_location": ("location_sk", "d_location", "location_sk"),
    "sales_order": ("order_id", "d_order", "order_id"),
}


def foreign_key_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    return orphan_report(tables["f_sales"], {name: (column, tables[dim], key) for name, (column, dim, key) in FOREIGN_KEYS.items()})


def primary_key_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    return duplicate_report({name: (tables[name], key) for name, key in PRIMARY_KEYS.items() if name in tables})


# ---- monthly aggregate ----------------------------------------------------------


@metric("order_date", "region", "category", "order_id", "sales", "profit", "quantity", "discount")
def agg_sales_monthly(df: DataFrame) -> DataFrame:
    sums = df.groupBy(F.trunc("order_date", "month").alias("m"), "region", "category").agg(
        F.count_distinct("order_id").alias("total_orders"),
        F.sum("sales").alias("total_sales"),
        F.sum("profit").alias("total_profit"),
        F.sum("quantity").alias("total_quantity"),
        F.count(F.lit(1)).alias("transaction_count"),
        n.ratio(F.sum("discount"), F.count("discount")).alias("avg_discount"),
    )
    return sums.select(
        F.year("m").alias("year"),
        F.month("m").alias("month"),
        F.date_format("m", "MMMM").alias("month_name"),
        F.quarter("m").alias("quarter"),
        "region",
        "category",
        "total_orders",
        "total_sales",
        "total_profit",
        "total_quantity",
        "transaction_count",
        "avg_discount",
    )


ORDER_CELLS = ("year", "month", "region", "segment", "category")


@metric("order_date", "region", "segment", "category", "order_number")
def order_cells(df: DataFrame) -> DataFrame:
    """Which orders each cell of the aggregate holds, also by segment, as bitmaps."""
    dated = df.withColumns({"year": F.year("order_date"), "month": F.month("order_date")})
    return distinct_cells(dated, ORDER_CELLS, "order_number", "orders")


def from_monthly(aggregate: DataFrame, *keys: str, orders: DataFrame | None = None) -> DataFrame:
    """Additive measures of the aggregate on fewer keys, without reading the fact.

    Distinct orders do not add up across cells; with the rows of
    ``order_cells`` as ``orders`` they are counted from those.
    """
    known = {"year", "month", "month_name", "quarter", "region", "category"}
    if not set(keys) <= known:
        raise ValueError(f"the monthly aggregate has no {sorted(set(keys) - known)}")
    sums = aggregate.groupBy(*keys).agg(
        F.sum("total_sales").alias("total_sales"),
        F.sum("total_profit").alias("total_profit"),
        F.sum("total_quantity").alias("total_quantity"),
        F.sum("transaction_count").alias("transaction_count"),
    )
    if orders is None:
        return sums
    named = orders.withColumns(
        {
            "month_name": F.date_format(F.make_date("year", "month", F.lit(1)), "MMMM"),
            "quarter": F.quarter(F.make_date("year", "month", F.lit(1))),
        }
    )
    counted = roll_up(named, keys, "orders", "total_orders").withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return sums.join(counted, same, "left").drop(*[f"_{k}" for k in keys]).fillna(0, ["total_orders"])


class MonthlyTables:
    """A source that answers from the monthly aggregate what that covers.

    It covers metrics that add up measures by year, month, region and category
    within slices of region and year; all others read the lines. Beside the
    sums it counts orders by any of ``ORDER_CELLS``.
    """

    KEYS = frozenset({"region", "category"})
    MEASURES: Mapping[str, str] = {
        "sales": "total_sales", "profit": "total_profit", "quantity": "total_quantity", "lines": "transaction_count",
    }

    def __init__(self, source, aggregate: DataFrame, orders: DataFrame):
        self.source, self.aggregate, self.orders = source, aggregate, orders

    def view(self, *columns: str, summed: bool = False) -> DataFrame:
        return self.source.view(*columns, summed=summed)

    def covers(self, function, within: Slice) -> bool:
        read = {*function.columns, *within.columns} - {"order_date"}
        dated = "order_date" in function.columns and not function.monthly
        return function.summed and not dated and read <= {*self.KEYS, *self.MEASURES}

    def covering(self, function, within: Slice):
        """This source's aggregate, as a source, if it covers the metric; else the lines."""
        return _Cells(self.aggregate) if self.covers(function, within) else self.source

    def orders_by(self, *keys: str) -> DataFrame:
        if not set(keys) <= {*ORDER_CELLS}:
            raise ValueError(f"the order bitmaps have no {sorted(set(keys) - {*ORDER_CELLS})}")
        return roll_up(self.orders, keys, "orders", "order_count")

    def region_category(self) -> DataFrame:
        """``sales.region_category`` without the lines."""
        sums = from_monthly(self.aggregate, "region", "category", orders=self.orders)
        return sums.orderBy(F.desc("total_sales"), "region", "category").select(
            "region", "category", n.real(F.col("total_sales")).alias("total_sales"),
            n.real(F.col("total_profit")).alias("total_profit"), F.col("total_orders").alias("order_count"),
        )


class _Cells:
    """Rows of the monthly aggregate under the names of the view."""

    def __init__(self, aggregate: DataFrame):
        self.aggregate = aggregate

    def view(self, *columns: str, summed: bool = False) -> DataFrame:
        day = F.make_date("year", "month", F.lit(1)).alias("order_date")
        return self.aggregate.select(
            *[day if c == "order_date" else F.col(MonthlyTables.MEASURES.get(c, c)).alias(c) for c in columns]
        )


#: Business key and tracked columns of the dimensions with history.
HISTORIES = {"customer": ("customer_id", CUSTOMER), "product": ("product_id", PRODUCT)}


def next_versions(dim: DataFrame, incoming: DataFrame, kind: str, run_date: dt.date, expire_missing: bool = False):
    """Next snapshot of the customer or product dimension."""
    key, tracked = HISTORIES[kind]
    return apply_versions(dim, incoming, f"{kind}_sk", key, tracked, run_date, expire_missing)
