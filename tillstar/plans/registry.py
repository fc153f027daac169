"""Every query by name, over the Parquet tables of a folder."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstar.functions import numbers as n
from tillstar.functions.text import squeeze
from tillstar.operators import history, quality
from tillstar.operators.keyed import lookup_key
from tillstar.operators.metric import compute
from tillstar.operators.slices import Slice
from tillstar.plans import (
    basket,
    customers,
    exports,
    forecast,
    overview,
    pareto,
    profit_model,
    profitability,
    sales,
    segments,
    shipping,
    timeline,
)
from tillstar.plans import warehouse as w
from tillstar.session import delete_at_end, freed_exchanges, new_folder, remove_folder, settle, size_tasks, tune
from tillstar.sources import store
from tillstar.sources.tables import TABLE_SCHEMAS, ParquetTables, StarTables, as_reported

# Parameters of the registered queries; the tables' discounts end at 0.10.
CUTS = (0, 0.02, 0.05)
TIERS = ("Sin desc.", "≤2%", "≤5%", ">5%")
HIGH_DISCOUNT = 0.05
SLICE = Slice("EUROPE", 1997, "BUILDING")
ALERT_REGION, ALERT_CATEGORY = "ASIA", "PROMO"
CUT = dt.date(1997, 1, 1)  # orders before it make the first load, the others the next batch
GONE_EVERY = 7  # customers whose key it divides are not in the thinned batch
CELL_BYTES = 8 * 2**20  # of a row group of bitmaps, which unfold to many times that
LOADED_ON, RUN_DATE = dt.date(1995, 1, 1), dt.date(2021, 6, 1)

Query = Callable[[ParquetTables], DataFrame]


def _metric(function, within: Slice | None = None, **options) -> Query:
    return lambda src: compute(function, src, within, **options)


def _whole(function, **options) -> Query:
    """A metric that applies its slice itself, to parts of the whole view."""
    return lambda src: function(src.view(*function.columns, summed=function.summed), **options)


# ---- inputs derived from the tables ------------------------------------------


def _states(src: ParquetTables) -> DataFrame:
    """A state lookup that leaves the AFRICA states out."""
    nations = src.table("nation").join(src.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.filter(F.col("r_name") != "AFRICA").select(
        F.col("n_name").alias("state"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("abbr")
    )


def _buyers(src: ParquetTables, test) -> DataFrame:
    orders = src.table("orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day")).filter(test)
    return src.table("customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


def _first_customers(src: ParquetTables) -> DataFrame:
    """Customer dimension after the first load: those who ordered before 1997."""
    buyers = _buyers(src, F.col("day") < F.lit(CUT)).select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("segment"),
    )
    return history.first_versions(buyers, "customer_sk", "customer_id", w.CUSTOMER, LOADED_ON)


def _last_customers(src: ParquetTables) -> DataFrame:
    """The next batch: all buyers since 1997, those in debt moved to another segment."""
    return _buyers(src, F.col("day") >= F.lit(CUT)).select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.when(F.col("c_acctbal") < 0, "ARREARS").otherwise(F.col("c_mktsegment")).alias("segment"),
    )


def _thinned_customers(src: ParquetTables) -> DataFrame:
    """The next batch without every seventh customer, so that some have vanished at every scale."""
    return _last_customers(src).filter(F.col("customer_id") % GONE_EVERY != 0)


def _orphans(src: ParquetTables) -> DataFrame:
    """All order lines against dimensions that hold the first load only."""

    def known(column: str) -> DataFrame:
        columns = dict.fromkeys((column, "order_date"))
        return src.view(*columns).filter(F.col("order_date") < F.lit(CUT)).select(column)

    checks = {
        "order_date": ("order_date", "order_date"),
        "ship_date": ("ship_date", "order_date"),
        "order": ("order_id", "order_id"),
        "product": ("product_id", "product_id"),
        "customer": ("customer_id", "customer_id"),
        "location": ("city", "city"),
    }
    rows = src.view(*[column for column, _ in checks.values()])
    return quality.orphan_report(rows, {name: (column, known(key), key) for name, (column, key) in checks.items()})


def _unknown_keys(src: ParquetTables) -> DataFrame:
    """Order lines per customer key when the dimension holds the first load only."""
    dim = _first_customers(src)
    keyed = lookup_key(src.view("customer_id", "sales"), dim, {"customer_id": "customer_id"}, "customer_sk", unknown=-1)
    return keyed.groupBy("customer_sk").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("sales").cast("double").alias("sales")
    )


def _dirty_names(src: ParquetTables) -> DataFrame:
    """Customer names with doubled, tabbed and non-breaking spaces, cleaned."""
    dirty = F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit(" \t  ")), F.lit("  "))
    return src.table("customer").select(F.col("c_custkey").alias("customer_id"), squeeze(dirty).alias("customer_name"))


def _dirty_dates(src: ParquetTables) -> DataFrame:
    """Orders whose date is text, unreadable for pending ones, through the cleaning step."""
    day = F.col("o_orderdate").cast("date")
    text = F.concat_ws("/", F.dayofmonth(day), F.month(day), F.year(day))
    raw = src.table("orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.when(F.col("o_orderstatus") == "P", "99/99/2014").otherwise(text).alias("order_date"),
        text.alias("ship_date"),
    )
    return w.clean(raw)


def _customer_money(src: ParquetTables) -> DataFrame:
    sums = src.view("customer_id", "sales", "profit", summed=True).groupBy("customer_id").agg(
        F.sum("sales").alias("s"), F.sum("profit").alias("p")
    )
    return sums.select(
        "customer_id",
        n.money_short(F.col("s")).alias("sales_short"),
        n.money_short(F.col("p")).alias("profit_short"),
        n.money(F.col("s")).alias("sales_text"),
        n.money(F.col("p"), 2).alias("profit_text"),
    )


def _cells(src: ParquetTables) -> w.MonthlyTables:
    """The monthly aggregate and the bitmaps of its orders, written out."""
    aggregate = settle(compute(w.agg_sales_monthly, src), "agg-monthly")
    cells = settle(compute(w.order_cells, src), "order-cells", row_group_bytes=CELL_BYTES)
    return w.MonthlyTables(src, aggregate, cells)


def _from_cells(function, within: Slice | None = None, **options) -> Query:
    return lambda src: compute(function, _cells(src), within, **options)


def _year_region(src: ParquetTables) -> DataFrame:
    cells = _cells(src)
    return _doubles(w.from_monthly(cells.aggregate, "year", "region", orders=cells.orders), "total_sales", "total_profit")


def _doubles(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _fact(src: ParquetTables) -> DataFrame:
    return w.build_star(src, RUN_DATE)["f_sales"]


# Least buckets of a stored part, bytes of the lines' file that go to one bucket, and most parts.
STORED_BUCKETS, BUCKET_BYTES, MOST_PARTS = 16, 4 * 2**20, 8


class _StoredStar:
    """A star whose fact and orders are stored part by part, in the same buckets by order.

    An order and its lines are in one part, so the view over the star is that
    over its parts. Of what the exchanges of the lines leave on disk, only one
    part's share is there at a time.
    """

    def __init__(self, src: ParquetTables):
        star, spark = w.build_star(src, RUN_DATE), src.spark
        grown = 1 << max(0, -(-src.bytes("lineitem") // (STORED_BUCKETS * BUCKET_BYTES)) - 1).bit_length()
        count = min(grown, MOST_PARTS)
        self.parts, self.folders = [], []
        for number in range(count):
            part, folders = dict(star), []
            for name in ("f_sales", "d_order"):
                rows = star[name].filter(F.pmod(F.xxhash64("order_id"), F.lit(count)) == number) if count > 1 else star[name]
                table, folder, buckets = f"stored_{name}_{uuid.uuid4().hex}", new_folder(spark, f"stored-{name}"), STORED_BUCKETS * grown // count
                delete_at_end(spark, folder)
                dealt = rows.repartition(buckets, "order_id")
                with freed_exchanges(spark):
                    dealt.write.bucketBy(buckets, "order_id").sortBy("order_id").option("path", folder).saveAsTable(table)
                part[name] = spark.table(table)
                folders.append(folder)
            self.parts.append(StarTables(part))
            self.folders.append(folders)

    def view(self, *columns: str, summed: bool = False) -> DataFrame:
        return reduce(DataFrame.unionByName, [part.view(*columns, summed=summed) for part in self.parts])


def _stored_view(src: ParquetTables) -> DataFrame:
    """The sales view over the stored star; that of several parts is written out, and each part goes when its view is there."""
    star = _StoredStar(src)
    if len(star.parts) == 1:
        return as_reported(star.view())
    views = []
    for part, folders in zip(star.parts, star.folders, strict=True):
        views.append(settle(as_reported(part.view()), "stored-view"))
        for folder in folders:
            remove_folder(src.spark, folder)
    return reduce(DataFrame.unionByName, views)


def _reconciled(src: ParquetTables) -> DataFrame:
    """Fact and clean lines against all lines, where lines without a full day in transit count as unclean."""
    clean = src.view("order_id", "order_date", "ship_date").filter(F.datediff("ship_date", "order_date") >= 1)
    return quality.reconcile(_fact(src), clean, src.lines().count())


def _versions(expire_missing: bool) -> Query:
    def run(src: ParquetTables) -> DataFrame:
        dim = _first_customers(src)
        return w.next_versions(dim, _last_customers(src), "customer", RUN_DATE, expire_missing)

    return run


def _bucket_versions(expire_missing: bool) -> Query:
    """As ``_versions``, but only buckets with a change are made anew."""

    def run(src: ParquetTables) -> DataFrame:
        dim = settle(_first_customers(src).withColumn("bucket", history.bucket_of("customer_id")), "d-customer")
        rows, changed = history.apply_in_buckets(
            dim, _thinned_customers(src), "customer_sk", "customer_id", w.CUSTOMER, RUN_DATE, expire_missing
        )
        return dim.filter(~F.col("bucket").isin(changed)).unionByName(rows).drop("bucket")

    return run


def _bucket_report(src: ParquetTables) -> DataFrame:
    """Members and changes per bucket of the customer dimension."""
    changes = _changes(src, _thinned_customers).groupBy(history.bucket_of("customer_id").alias("bucket"))
    return changes.agg(
        F.count(F.lit(1)).alias("members"), F.count_if(F.col("status").isin(history.NEW, history.CHANGED)).alias("changes")
    )


def _changes(src: ParquetTables, batch=_last_customers) -> DataFrame:
    return history.detect_changes(_first_customers(src), batch(src), "customer_id", w.CUSTOMER)


def _rules(item: str, top: int | None) -> Query:
    def run(src: ParquetTables) -> DataFrame:
        return basket.association_rules(src.view("order_id", item), item, top=top).rules

    return run


_made: dict[tuple, tuple[str, object]] = {}


def _once(src: ParquetTables, name: str, build):
    """What a session has fitted for a folder, so that a model is fitted once.

    It is kept with the fingerprint of the files it was fitted on, and dropped
    when these change.
    """
    key = (src.spark.sparkContext.applicationId, src.folder, name)
    files = store.file_fingerprint(src.spark, *[f"{src.folder}/{t}.parquet" for t in TABLE_SCHEMAS])
    if key not in _made or _made[key][0] != files:
        _made.pop(key, None)
        _made[key] = (files, build())
    return _made[key][1]


def _profit_model(src: ParquetTables) -> profit_model.ProfitModel:
    return _once(src, "profit_model", lambda: compute(profit_model.fit, src))


def _scores(src: ParquetTables) -> DataFrame:
    model = _profit_model(src)
    scenarios = profit_model.scenario_grid(
        src.spark,
        sales=[100.0, 500.0, 5000.0, 50_000.0],
        discount=[0.0, 0.1],
        quantity=[1, 10],
        category=[*sorted(model.levels["category"]), "UNSEEN"],
        region=["EUROPE"],
        segment=["BUILDING"],
        ship_mode=["1-URGENT"],
        month=[7],
    )
    return model.score(scenarios)


def _model_info(src: ParquetTables) -> DataFrame:
    info = _profit_model(src).info(src.spark)
    return info.withColumns({c: F.array_join(c, ", ") for c in profit_model.CATEGORIES})


def _model_check(src: ParquetTables) -> DataFrame:
    rows = profit_model.training_rows(src.view(*profit_model.fit.columns))
    return profit_model.check(_profit_model(src), rows)


def _found(src: ParquetTables, segment, base) -> segments.Segments:
    return _once(src, segment.__name__, lambda: segment(compute(base, src)))


def _members(segment, base, *columns: str) -> Query:
    return lambda src: _found(src, segment, base).members.select(*columns, "cluster_label", "cluster_rank")


def _profile(segment, base) -> Query:
    return lambda src: _found(src, segment, base).profile.drop("cluster", "score")


def _checked(segment, base) -> Query:
    return lambda src: segments.check(_found(src, segment, base))


class _WithNulls:
    """The view of a source with names, regions and categories that are sometimes unknown."""

    def __init__(self, src: ParquetTables):
        self.src = src

    def view(self, *columns: str, summed: bool = False) -> DataFrame:
        rules = {
            "category": ("discount", F.col("discount") == F.lit(0.1).cast("decimal(5,4)")),
            "region": ("ship_mode", F.col("ship_mode") == "1-URGENT"),
            "customer_name": ("order_date", F.col("order_date") < F.lit(dt.date(1995, 6, 1))),
        }
        read = dict.fromkeys([*columns, *[rules[c][0] for c in columns if c in rules]])
        rows = self.src.view(*read)
        return rows.withColumns({c: F.when(~rules[c][1], F.col(c)) for c in columns if c in rules}).select(*columns)


def _unknown(function) -> Query:
    return lambda src: compute(function, _WithNulls(src))


SHEETS = {
    "overview": ("top_products", "pareto", "monthly"),
    "sales": ("top_products", "by_category", "by_region", "monthly", "by_subcategory", "by_city"),
    "profitability": ("discount_tiers", "discount_loss", "region_category"),
    "customers": ("segments", "frequency"),
    "shipping": ("general", "by_region", "by_mode"),
}


def _sheet(module: str, name: str) -> Query:
    return lambda src: exports.sheets(src, module, cuts=CUTS, labels=TIERS, threshold=HIGH_DISCOUNT)[name]


def _current_versions(src: ParquetTables) -> DataFrame:
    return history.current(_versions(True)(src))


def _next_key(src: ParquetTables) -> DataFrame:
    return src.spark.createDataFrame([(history.next_key(_first_customers(src), "customer_sk"),)], "next_sk bigint")


def _exact(function, *columns: str) -> Query:
    return lambda src: _doubles(compute(function, src), *columns)


QUERIES: dict[str, Query] = {
    # view, filters, cleaning
    "sales_view": lambda src: as_reported(src.view()),
    "star_join": lambda src: as_reported(StarTables(w.build_star(src, RUN_DATE)).view()),
    "star_join_stored": _stored_view,
    "ship_modes_stored": lambda src: compute(shipping.by_mode, _StoredStar(src)),
    "export_rows": lambda src: exports.export_rows(src, SLICE),
    "filter_region_year_segment": lambda src: overview.headline(src, SLICE),
    "ship_not_null": _metric(shipping.with_both_dates),
    "filter_coverage": _whole(overview.filter_coverage, within=SLICE),
    "filter_values": _metric(overview.filter_values),
    "clean_strings": _dirty_names,
    "clean_dates": _dirty_dates,
    "profile_outliers": _metric(w.profile),
    "fmt_money": _customer_money,
    "status_bands": _metric(profitability.status_bands),
    # unknown members, report sheets
    "unknown_by_category": _unknown(sales.by_category),
    "unknown_top_customers": _unknown(customers.top_customers),
    "unknown_segment_cards": _unknown(customers.segment_cards),
    "unknown_profit_grid": _unknown(segments.profit_grid),
    "unknown_rfm_base": _unknown(segments.rfm_base),
    "sheet_kpis": _sheet("overview", "kpis"),
    "sheet_top_customers": _sheet("customers", "top_customers"),
    **{f"sheet_{module}_{name}": _sheet(module, name) for module, names in SHEETS.items() for name in names},
    # headline figures
    "kpis": overview.headline,
    "kpi_yoy": overview.year_on_year,
    "kpi_yoy_reference": lambda src: overview.year_on_year(src, mode="reference"),
    "kpi_yoy_slice": lambda src: overview.year_on_year(src, SLICE),
    "alerts": _whole(
        overview.alerts, within=SLICE, threshold=HIGH_DISCOUNT, region=ALERT_REGION, category=ALERT_CATEGORY
    ),
    "quantity_stats": _metric(overview.quantity_stats),
    "units_by_category": _metric(overview.units_by_category),
    "top5_products": _metric(overview.top_products),
    # sales
    "q1_region_category": _metric(sales.region_category),
    "q2_top_products": _metric(sales.most_profitable_products),
    "q5_discount_impact": _metric(sales.discount_impact, cuts=CUTS),
    "sales_by_category": _metric(sales.by_category),
    "sales_by_region": _metric(sales.by_region),
    "sales_by_segment": _metric(sales.by_segment),
    "sales_by_subcategory": _metric(sales.by_subcategory),
    "sales_by_city": _metric(sales.by_city),
    "sales_by_state": lambda src: compute(sales.by_state, src, lookup=_states(src)),
    "top_products_sales": _metric(sales.top_products),
    # profitability
    "discount_tiers": _metric(profitability.discount_tiers, cuts=CUTS, labels=TIERS),
    "discount_loss": _metric(profitability.discount_loss, threshold=HIGH_DISCOUNT),
    "profit_region_category": _metric(profitability.by_region_category),
    "profit_winner": _metric(profitability.winner),
    "profit_heatmap": _metric(profitability.heatmap),
    # customers
    "segment_cards": _metric(customers.segment_cards),
    "segment_margin": _metric(customers.segment_margin),
    "top_customers": _metric(customers.top_customers),
    "customer_insight": _metric(customers.insight),
    "customer_frequency": _metric(customers.frequency),
    # shipping
    "shipping_stats": _metric(shipping.stats),
    "shipping_by_mode": _metric(shipping.by_mode),
    "shipping_by_region": _metric(shipping.kpis_by_region),
    "delivery_days_region": _metric(shipping.delivery_days_by_region),
    "delivery_histogram": _metric(shipping.histogram),
    "ship_mode_impact": _metric(shipping.mode_impact),
    "orders_per_month": _metric(shipping.lines_per_month),
    # time and concentration
    "monthly_sales": _metric(timeline.monthly_sales),
    "monthly_trend": _metric(timeline.monthly_trend),
    "mom_change": _metric(timeline.mom_change),
    "mom_last": _metric(timeline.mom_last),
    "month_spine": _metric(timeline.month_spine),
    "forecast_features": _metric(timeline.forecast_features),
    "pareto_products": _metric(pareto.products),
    "pareto_summary": _metric(pareto.product_summary),
    "pareto_customers": _metric(pareto.customer_summary),
    # star
    "dim_date": _metric(w.d_date),
    "dim_customer": _metric(w.d_customer, run_date=RUN_DATE),
    "dim_product": _metric(w.d_product, run_date=RUN_DATE),
    "dim_location": _metric(w.d_location),
    "dim_order": _metric(w.d_order),
    "dim_segment": _metric(w.d_segment),
    "fact_build": lambda src: _doubles(_fact(src), "sales", "discount", "profit"),
    "fact_unknown_keys": _unknown_keys,
    "agg_sales_monthly": _exact(w.agg_sales_monthly, "total_sales", "total_profit"),
    "agg_year_region": _year_region,
    "cells_region_category": lambda src: _cells(src).region_category(),
    "cells_orders_by_segment": lambda src: _cells(src).orders_by("year", "segment"),
    "cells_by_category": _from_cells(sales.by_category),
    "cells_by_region_1997": _from_cells(sales.by_region, Slice(year=1997)),
    "cells_monthly_trend": _from_cells(timeline.monthly_trend),
    "scd2_changes": _changes,
    "scd2_deletes": lambda src: history.missing_keys(_first_customers(src), _thinned_customers(src), "customer_id"),
    "scd2_apply": _versions(False),
    "scd2_apply_expiring": _versions(True),
    "scd2_apply_buckets": _bucket_versions(False),
    "scd2_expire_buckets": _bucket_versions(True),
    "scd2_buckets": _bucket_report,
    "scd2_current": _current_versions,
    "scd2_next_key": _next_key,
    "fk_orphans": _orphans,
    "pk_duplicates": lambda src: w.primary_key_report(w.build_star(src, RUN_DATE)),
    "reconcile": _reconciled,
    # models
    "rfm_base": _metric(segments.rfm_base),
    "rfm_features": lambda src: segments.rfm_features(compute(segments.rfm_base, src)),
    "rfm_segments": _members(
        segments.segment_customers, segments.rfm_base, "customer_id", "customer_name", "segment", "recency",
        "frequency", "monetary",
    ),
    "rfm_profile": _profile(segments.segment_customers, segments.rfm_base),
    "rfm_check": _checked(segments.segment_customers, segments.rfm_base),
    "product_profile": _metric(segments.product_profile),
    "product_segments": _members(
        segments.segment_products, segments.product_profile, "product_name", "category", "sub_category", "sales",
        "profit", "margin", "discount_avg", "order_count",
    ),
    "product_check": _checked(segments.segment_products, segments.product_profile),
    "profit_grid": _metric(segments.profit_grid),
    "profit_segments": _members(
        segments.segment_profitability, segments.profit_grid, "region", "category", "segment", "profit", "margin",
        "discount_avg", "sales", "order_count",
    ),
    "profit_segments_check": _checked(segments.segment_profitability, segments.profit_grid),
    "basket_items": lambda src: basket.basket_items(src.view("order_id", "sub_category")),
    "basket_rules": _rules("category", None),
    "basket_top_rules": _rules("category", basket.TOP),
    "basket_brand_rules": _rules("sub_category", None),
    "forecast": _metric(forecast.forecast),
    "forecast_metrics": _metric(forecast.forecast_metrics),
    "forecast_check": _metric(forecast.forecast_check),
    "profit_model": lambda src: _profit_model(src).coefficients(src.spark).withColumn("coefficient", F.bround("coefficient", 4)),
    "profit_model_check": _model_check,
    "profit_model_info": _model_info,
    "profit_scores": _scores,
}


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    src = ParquetTables(tune(spark), folder)
    size_tasks(spark, src.bytes("lineitem"))
    return QUERIES[name](src)
