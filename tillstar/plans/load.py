"""The whole load: raw lines, clean lines, star, aggregates, checks, audit.

A load either replaces the fact or, as a refresh, only the years its batch has
lines of. Histories are rewritten bucket by bucket. A load that failed is taken
up again at the step that failed.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstar.functions.text import column_name, raw_date, with_snake_names
from tillstar.operators.history import apply_in_buckets, bucket_of, new_members
from tillstar.operators.keyed import first_per_key
from tillstar.operators.ordered import with_dense_key
from tillstar.operators.quality import reconcile
from tillstar.plans import warehouse as w
from tillstar.schemas import PARTITIONS, REJECTED
from tillstar.session import own_folders, settle, tune
from tillstar.sources import store
from tillstar.sources.rawcsv import FILE, readable_lines, rejected_lines, scan_order_lines
from tillstar.sources.tables import StarTables

REQUIRED = (
    "order_id", "order_date", "ship_date", "ship_mode", "customer_id", "customer_name", "segment",
    "country", "region", "state", "city", "postal_code", "product_id", "product_name", "category",
    "sub_category", "sales", "quantity", "discount", "profit",
)


# parts that the lines of a day are dealt into when the fact is written
DAY_PARTS = 16
# the step that ends a load, and those whose output is a table that a load taken up again reads
LAST_STEP = "load_total"


@dataclass(frozen=True)
class LoadSettings:
    """What a load reads and writes.

    ``refresh`` replaces only the years that the lines belong to, which must be
    there in whole; without it the lines are all there are. ``resume`` takes up
    an unfinished load of the same input files and settings. ``fact_buckets``
    stores fact and orders in as many buckets by order, so that they join
    without moving lines.
    """

    csv_path: str
    run_date: dt.date
    raw_database: str = "raw"
    database: str = "mart"
    unknown_sk: int = 1
    expire_missing: bool = False
    strict_dates: bool = False
    skip_if_loaded: bool = False
    refresh: bool = False
    resume: bool = True
    fact_buckets: int = 0


def title(name: str) -> str:
    """Header form of a snake-case name."""
    return {"order_id": "Order ID", "customer_id": "Customer ID", "product_id": "Product ID", "sub_category": "Sub-Category"}.get(
        name, name.replace("_", " ").title()
    )


def extract(spark: SparkSession, settings: LoadSettings) -> DataFrame:
    """CSV to the raw table; snake or title headers are both accepted.

    Lines that cannot be read whole go to ``order_lines_rejected``.
    """
    scanned = settle(scan_order_lines(spark, settings.csv_path), "scanned")
    lines = readable_lines(scanned)
    for name in REQUIRED:
        column_name(lines, name, title(name))
    store.ensure_database(spark, settings.raw_database)
    store.replace_table(rejected_lines(scanned), f"{settings.raw_database}.order_lines_rejected")
    named = with_snake_names(lines.withColumnRenamed(FILE, "source_file"))
    return store.replace_table(named, f"{settings.raw_database}.order_lines")


def reject_dates(raw: DataFrame, database: str) -> DataFrame:
    """Adds raw lines without two readable dates to the rejected ones; returns the table."""
    dates = ("order_date", "ship_date")
    bad = F.concat_ws(", ", *[F.when(raw_date(F.col(c)).isNull(), F.lit(c)) for c in dates])
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns if c not in ("source_row", "source_file")]))
    lines = raw.withColumn("_bad", bad).filter(F.col("_bad") != "")
    rows = lines.select(
        F.lit("transform").alias("step"), F.col("source_file").alias("file"), "source_row",
        F.concat(F.lit("unreadable "), F.col("_bad")).alias("reason"), record.alias("record"),
    )
    table = f"{database}.order_lines_rejected"
    before = raw.sparkSession.table(table).filter("step = 'extract'")
    return store.replace_table(before.unionByName(rows).select(*[f.name for f in REJECTED.fields]), table)


def _history(spark: SparkSession, settings: LoadSettings, clean: DataFrame, kind: str) -> DataFrame:
    """Customer or product dimension: first load, or the buckets of its history that change."""
    name = f"d_{kind}"
    table = f"{settings.database}.{name}"
    incoming = {"customer": w.customers_of, "product": w.products_of}[kind](clean, "source_row")
    existing = spark.table(table)
    key, tracked = w.HISTORIES[kind]
    if existing.isEmpty():
        first = {"customer": w.d_customer, "product": w.d_product}[kind]
        members = first(clean, settings.run_date, "source_row").withColumn("bucket", bucket_of(key))
        return store.replace_table(store.as_declared(members, name).repartition("bucket"), table, PARTITIONS[name])
    members = settle(incoming, f"{kind}-members")
    # what a batch of some years does not name has not vanished
    expire = settings.expire_missing and not settings.refresh
    rows, changed = apply_in_buckets(existing, members, f"{kind}_sk", key, tracked, settings.run_date, expire)
    if changed:
        following = settle(store.as_declared(rows, name).repartition("bucket"), f"{kind}-buckets")
        store.overwrite_partitions(following, table)
    return spark.table(table)


def _orders(clean: DataFrame) -> DataFrame:
    """The orders of the lines, with ship mode and first day."""
    return first_per_key(clean, ["order_id"], ["ship_mode", "order_date"], "source_row")


def _members(
    spark: SparkSession, settings: LoadSettings, clean: DataFrame, name: str, build: Callable[[DataFrame], DataFrame], key: Mapping[str, list[str]]
) -> DataFrame:
    """A dimension without history: made anew, or in a refresh joined by the members it lacks.

    Members that are there keep their surrogate key, which lines of other years hold.
    """
    table = f"{settings.database}.{name}"
    existing = spark.table(table)
    if settings.refresh and not existing.isEmpty():
        surrogate, columns = key[name]
        fresh = settle(store.as_declared(new_members(existing, build(clean), surrogate, columns), name), f"{name}-new")
        return existing if fresh.isEmpty() else store.append_table(fresh, table)
    return store.replace_table(store.as_declared(build(clean), name), table)


def _order_dimension(spark: SparkSession, settings: LoadSettings, clean: DataFrame) -> DataFrame:
    """Orders with a dense number, by day, so that the orders of a month share bitmaps.

    A refresh keeps the numbers of known orders and appends the others; only if
    a known order has another ship mode is the table written again.
    """
    table, orders = f"{settings.database}.d_order", settle(_orders(clean), "orders")
    existing, by_order = spark.table(table), (settings.fact_buckets, "order_id") if settings.fact_buckets else None
    if not settings.refresh or existing.isEmpty():
        numbered = with_dense_key(orders, "order_number", ["order_date", "order_id"])
        return store.replace_table(store.as_declared(numbered, "d_order"), table, bucket_by=by_order)
    known = existing.join(orders.select("order_id", F.col("ship_mode").alias("_now")), "order_id")
    changed = not known.filter(~F.col("ship_mode").eqNullSafe(F.col("_now"))).isEmpty()
    fresh = orders.join(existing.select("order_id"), "order_id", "left_anti")
    top = existing.agg(F.coalesce(F.max("order_number"), F.lit(0))).first()[0]
    added = store.as_declared(with_dense_key(fresh, "order_number", ["order_date", "order_id"], start=top + 1), "d_order")
    if not (changed or by_order):
        return store.append_table(settle(added, "orders-new"), table)
    now = existing.join(orders.select("order_id", F.struct("ship_mode").alias("_now")), "order_id", "left")
    kept = now.withColumn("ship_mode", F.when(F.col("_now").isNotNull(), F.col("_now.ship_mode")).otherwise(F.col("ship_mode")))
    return store.replace_table(kept.drop("_now").unionByName(added), table, bucket_by=by_order)


def _write_fact(settings: LoadSettings, rows: DataFrame, partial: bool) -> DataFrame:
    table = f"{settings.database}.f_sales"
    if settings.fact_buckets:
        dealt = rows.repartition(settings.fact_buckets, "order_id")
    else:
        # a task gets salted parts of days, so no day or order is too large for
        # one, and its files hold each day in one stretch
        salt = F.pmod(F.xxhash64("order_id", "product_sk", "sales", "profit"), F.lit(DAY_PARTS))
        dealt = rows.repartition("order_year", "order_date_sk", salt).sortWithinPartitions("order_year", "order_date_sk")
    if partial:
        return store.overwrite_partitions(dealt, table)
    by_order = (settings.fact_buckets, "order_id") if settings.fact_buckets else None
    return store.replace_table(dealt, table, PARTITIONS["f_sales"], by_order)


def run_load(spark: SparkSession, settings: LoadSettings) -> bool:
    """Run every step in order; a failing step is logged and stops the load.

    Returns False when ``skip_if_loaded`` finds facts already there.
    """
    tune(spark)
    db = settings.database
    store.ensure_database(spark, settings.raw_database)
    store.ensure_tables(spark, db)
    if settings.skip_if_loaded and not spark.table(f"{db}.f_sales").isEmpty():
        return False
    with own_folders(spark):
        _load(spark, settings)
    return True


def _load(spark: SparkSession, settings: LoadSettings) -> None:
    db, raw_db, started = settings.database, settings.raw_database, time.monotonic()
    inputs = f"{settings} {store.file_fingerprint(spark, settings.csv_path)}"
    ledger = store.Ledger(spark, db, inputs, LAST_STEP)
    refresh = settings.refresh and not spark.table(f"{db}.f_sales").isEmpty()

    def step(
        name: str,
        message: str,
        table: str,
        work: Callable[[], DataFrame],
        verdict: Callable[[int], str] = lambda rows: "OK",
        count: Callable[[DataFrame], int] = lambda result: result.count(),
    ) -> DataFrame:
        """Do a step whose result is in ``table``, or read that if an earlier attempt did it."""
        begun = time.monotonic()
        if settings.resume and name in ledger.complete and spark.catalog.tableExists(table):
            store.log_step(spark, db, name, ledger.complete[name], "SKIP", "Complete in an earlier attempt", 0.0)
            return spark.table(table)
        try:
            result = work()
            rows = count(result)
        except Exception as problem:
            store.log_step(spark, db, name, 0, "ERROR", str(problem), time.monotonic() - begun)
            raise
        store.log_step(spark, db, name, rows, verdict(rows), message, time.monotonic() - begun)
        ledger.done(name, rows)
        return result

    raw = step("extract", "Raw order lines", f"{raw_db}.order_lines", lambda: extract(spark, settings))
    clean = step(
        "transform",
        "Clean order lines",
        f"{raw_db}.order_lines_clean",
        lambda: store.replace_table(w.clean(raw.drop("source_file"), settings.strict_dates), f"{raw_db}.order_lines_clean"),
    )
    rejected = step(
        "rejects",
        "Lines that could not be read whole",
        f"{raw_db}.order_lines_rejected",
        lambda: reject_dates(raw, raw_db),
        lambda rows: "WARN" if rows else "OK",
    )
    keys = {
        "d_date": ("date_sk", ["date"]),
        "d_location": ("location_sk", list(w.LOCATION)),
        "d_segment": ("segment_sk", ["segment_name"]),
    }

    def dimension(name: str, message: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return step(name, message, f"{db}.{name}", lambda: _members(spark, settings, clean, name, build, keys))

    dims = {
        "d_date": dimension("d_date", "Date dimension", w.d_date),
        "d_customer": step(
            "d_customer", "Customer dimension, versioned", f"{db}.d_customer", lambda: _history(spark, settings, clean, "customer")
        ),
        "d_product": step(
            "d_product", "Product dimension, versioned", f"{db}.d_product", lambda: _history(spark, settings, clean, "product")
        ),
        "d_location": dimension("d_location", "Location dimension", w.d_location),
        "d_order": step("d_order", "Order dimension", f"{db}.d_order", lambda: _order_dimension(spark, settings, clean)),
        "d_segment": dimension("d_segment", "Segment dimension", w.d_segment),
    }
    # the years whose partitions a refresh replaces; a handful of rows
    years = [r[0] for r in clean.select(F.year("order_date")).distinct().collect()] if refresh else []
    of_years = F.col("order_year").isin(years) if refresh else F.lit(True)
    step(
        "f_sales",
        f"Sales fact, years {sorted(years)}" if refresh else "Sales fact",
        f"{db}.f_sales",
        lambda: _write_fact(settings, store.as_declared(w.f_sales(clean, dims, settings.unknown_sk), "f_sales"), refresh),
        count=lambda fact: fact.filter(of_years).count(),
    )
    star = StarTables.from_catalog(spark, db)
    step(
        "constraints",
        "Key violations per check",
        f"{db}.key_violations",
        lambda: store.replace_table(key_violations(star), f"{db}.key_violations"),
        lambda rows: "WARN" if rows else "OK",
    )
    touched = StarTables({**star.tables, "f_sales": star.tables["f_sales"].filter(of_years)})
    for name, build in {"agg_sales_monthly": w.agg_sales_monthly, "agg_order_cells": w.order_cells}.items():

        def aggregate(name=name, build=build) -> DataFrame:
            cells = store.as_declared(build(touched.view(*build.columns)), name)
            if refresh:
                return store.overwrite_partitions(settle(cells, name), f"{db}.{name}")
            return store.replace_table(cells, f"{db}.{name}", PARTITIONS[name])

        step(name, "Monthly aggregate" if name == "agg_sales_monthly" else "Orders of the aggregate", f"{db}.{name}", aggregate)
    begun = time.monotonic()
    source = raw.count() + rejected.filter("step = 'extract'").count()
    verdict = reconcile(touched.tables["f_sales"], clean, source).first()
    store.log_step(
        spark, db, "reconcile", verdict["fact_rows"], verdict["status"], verdict["message"], time.monotonic() - begun
    )
    store.log_step(spark, db, LAST_STEP, verdict["source_rows"], "OK", "Load complete", time.monotonic() - started)
    ledger.done(LAST_STEP, verdict["source_rows"])


def key_violations(star: StarTables) -> DataFrame:
    """Checks that found orphans or duplicate keys, one row each."""
    orphans = w.foreign_key_report(star.tables).select(
        F.col("reference").alias("check"), F.col("orphan_rows").alias("rows")
    )
    repeats = w.primary_key_report(star.tables).select(
        F.col("table_name").alias("check"), F.col("duplicate_rows").alias("rows")
    )
    return orphans.unionByName(repeats).filter(F.col("rows") > 0)

