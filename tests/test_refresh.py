"""Loads in part: histories by bucket, years of the fact, steps taken up again, rejected lines, caches."""

from __future__ import annotations

import datetime as dt
import shutil
from collections import Counter

import pytest
from check_oracle import compare, connect
from lines import random_lines
from test_load import HEADER, row, write
from test_scale_paths import plan

import __spark_entry__ as entry
from tillstar.operators import distinct, history
from tillstar.operators.metric import compute
from tillstar.operators.slices import Slice
from tillstar.plans import load, overview, profitability, registry, sales, timeline
from tillstar.plans import warehouse as w
from tillstar.plans.load import LoadSettings, run_load
from tillstar.sources import store
from tillstar.sources.rawcsv import files_with_breaks, read_order_lines
from tillstar.sources.tables import ParquetTables, StarTables

FOLDER = "/root/testdata/sf0.001"


def files(spark, table):
    return {f.partition(".db/")[2]: f for f in spark.table(table).inputFiles()}


def buckets_of(paths):
    return {p.split("bucket=")[1].split("/")[0] for p in paths}


def many_customers(changed=()):
    rows = []
    for i in range(120):
        name = {"Customer ID": f"C-{i}", "Customer Name": f"Name {i}", "Order ID": f"O-{i}", "Product ID": f"P-{i % 30}", "Product Name": f"Thing {i % 30}"}
        rows.append(row(i, **name, **({"Segment": "Corporate"} if i in changed else {})))
    return rows


# ---- histories ------------------------------------------------------------------


def test_one_changed_customer_rewrites_one_bucket(spark, tmp_path):
    first = LoadSettings(write(tmp_path / "a.csv", many_customers()), dt.date(2020, 1, 1), "raw5", "mart5")
    assert run_load(spark, first)
    before = {t: files(spark, f"mart5.{t}") for t in ("d_customer", "d_product")}
    assert len(buckets_of(before["d_customer"].values())) > 20
    again = LoadSettings(write(tmp_path / "b.csv", many_customers({7})), dt.date(2020, 1, 2), "raw5", "mart5")
    assert run_load(spark, again)
    after = {t: files(spark, f"mart5.{t}") for t in before}
    assert after["d_product"] == before["d_product"]
    gone = [before["d_customer"][f] for f in before["d_customer"].keys() - after["d_customer"].keys()]
    come = [after["d_customer"][f] for f in after["d_customer"].keys() - before["d_customer"].keys()]
    assert len(buckets_of(gone)) == 1 and buckets_of(gone) == buckets_of(come)
    people = spark.table("mart5.d_customer")
    versions = people.filter("customer_id = 'C-7'").orderBy("customer_sk").collect()
    assert [(r.segment, r.current_flag) for r in versions] == [("Consumer", "N"), ("Corporate", "Y")]
    assert people.count() == 121 and people.select("customer_sk").distinct().count() == 121


def test_buckets_give_the_whole_snapshot(spark):
    old = [(i, f"k{i}", f"n{i}" if i % 5 else None, "s", dt.date(2020, 1, 1), None, "Y") for i in range(1, 80)]
    kind = "sk bigint, k string, name string, segment string, effective_date date, expiration_date date, current_flag string"
    dim = spark.createDataFrame(old, kind)
    new = [(f"k{i}", f"n{i}" if i % 5 else None, "other" if i % 17 == 0 else "s") for i in range(3, 90)]
    incoming = spark.createDataFrame(new, "k string, name string, segment string")
    for expire in (False, True):
        args = ("sk", "k", ("name", "segment"), dt.date(2020, 2, 1), expire)
        whole = Counter(tuple(r) for r in history.apply_versions(dim, incoming, *args).collect())
        stored = dim.withColumn("bucket", history.bucket_of("k"))
        rows, changed = history.apply_in_buckets(stored, incoming, *args)
        kept = stored.filter(~stored.bucket.isin(changed)).unionByName(rows).drop("bucket")
        assert Counter(tuple(r) for r in kept.collect()) == whole
        assert set(changed) == {r.bucket for r in rows.select("bucket").distinct().collect()}
    same = history.current(dim).select("k", "name", "segment")
    rows, changed = history.apply_in_buckets(dim.withColumn("bucket", history.bucket_of("k")), same, *args)
    assert changed == [] and rows.count() == 0


def test_a_failing_overwrite_keeps_every_partition(spark):
    store.ensure_database(spark, "part")
    store.replace_table(spark.range(20).selectExpr("id", "id % 4 AS bucket"), "part.t", ["bucket"])
    bad = spark.range(3).selectExpr("id div (id - id) AS id", "id AS bucket")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        store.overwrite_partitions(bad, "part.t")
    assert spark.table("part.t").count() == 20
    store.overwrite_partitions(spark.range(100, 102).selectExpr("id", "cast(2 AS bigint) AS bucket"), "part.t")
    assert sorted(r.id for r in spark.table("part.t").filter("bucket = 2").collect()) == [100, 101]
    assert spark.table("part.t").count() == 17


# ---- years of the fact ----------------------------------------------------------


def of_year(year, count, start=0, **changes):
    return [
        row(i, **{"Order ID": f"O-{year}-{i // 2}", "Order Date": f"{i % 28 + 1}/{i % 12 + 1}/{year}", "Customer ID": f"C-{i % 5}",
                  "Customer Name": f"Name {i % 5}", "Region": ["South", "West"][i % 2], "Category": ["Office", "Tech"][i % 4 % 2],
                  "Sales": f"{10 + i}.25", **changes})
        for i in range(start, start + count)
    ]


def reported(spark, database):
    star = StarTables.from_catalog(spark, database)
    cells = spark.table(f"{database}.agg_sales_monthly")
    orders = spark.table(f"{database}.agg_order_cells")
    return (
        Counter(tuple(r) for r in star.view().collect()),
        Counter(tuple(r) for r in cells.collect()),
        Counter(tuple(r) for r in w.from_monthly(cells, "year", "region", orders=orders).collect()),
        compute(overview.kpis, star).collect(),
    )


@pytest.mark.parametrize("buckets", [0, 4])
def test_a_batch_of_one_year_rewrites_that_year(spark, tmp_path, buckets):
    raw, db, whole = f"raw6{buckets}", f"mart6{buckets}", f"mart6all{buckets}"
    options = {"fact_buckets": buckets}
    y2015, y2016 = of_year(2015, 40), of_year(2016, 30)
    assert run_load(spark, LoadSettings(write(tmp_path / "a.csv", y2015 + y2016), dt.date(2020, 1, 1), raw, db, **options))
    before = set(files(spark, f"{db}.f_sales").values()), set(files(spark, f"{db}.agg_sales_monthly").values())
    # another 2016: fewer lines of a month, a new city and new days; who is known keeps name and segment
    batch = of_year(2016, 25, 3, City="Lyon") + of_year(2016, 3, 90, **{"Ship Mode": "Second"})
    assert run_load(spark, LoadSettings(write(tmp_path / "b.csv", batch), dt.date(2020, 1, 2), raw, db, refresh=True, **options))
    after = set(files(spark, f"{db}.f_sales").values()), set(files(spark, f"{db}.agg_sales_monthly").values())
    for old, new in zip(before, after):
        assert {f for f in old if "year=2015" in f} == {f for f in new if "year=2015" in f}
        assert not {f for f in old if "year=2016" in f} & new
    assert run_load(spark, LoadSettings(write(tmp_path / "c.csv", y2015 + batch), dt.date(2020, 1, 2), f"{raw}all", whole, **options))
    assert reported(spark, db) == reported(spark, whole)
    assert spark.table(f"{db}.key_violations").filter("check like 'sales_%'").count() == 0
    numbers = spark.table(f"{db}.d_order").select("order_number")
    assert numbers.distinct().count() == numbers.count()


def test_stored_orders_join_without_moving_lines(spark, tmp_path):
    settings = LoadSettings(write(tmp_path / "a.csv", of_year(2016, 30)), dt.date(2020, 1, 1), "raw7", "mart7", fact_buckets=4)
    assert run_load(spark, settings)
    star = StarTables.from_catalog(spark, "mart7")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(star.view("order_id", "ship_mode", "sales"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "Exchange" not in text
    assert star.view("order_id", "ship_mode", "sales").count() == 30


# ---- steps taken up again -------------------------------------------------------


def test_a_killed_load_goes_on_at_its_step(spark, tmp_path, monkeypatch):
    settings = LoadSettings(write(tmp_path / "a.csv", of_year(2016, 20)), dt.date(2020, 1, 1), "raw8", "mart8")
    fact = load.w.f_sales
    monkeypatch.setattr(load.w, "f_sales", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        run_load(spark, settings)
    monkeypatch.setattr(load.w, "f_sales", fact)
    kept = {t: files(spark, t) for t in ("raw8.order_lines", "raw8.order_lines_clean", "mart8.d_date", "mart8.d_customer", "mart8.d_order")}
    assert run_load(spark, settings)
    assert {t: files(spark, t) for t in kept} == kept
    log = spark.table("mart8.etl_log").orderBy("log_id").collect()
    assert [r.step for r in log if r.status == "ERROR"] == ["f_sales"]
    skipped = [r.step for r in log if r.status == "SKIP"]
    assert skipped == ["extract", "transform", "rejects", "d_date", "d_customer", "d_product", "d_location", "d_order", "d_segment"]
    assert spark.table("mart8.f_sales").count() == 20
    # a finished load is not taken up: the next one does every step
    assert run_load(spark, settings)
    log = spark.table("mart8.etl_log").orderBy("log_id").collect()
    assert sum(r.status == "SKIP" for r in log) == 9 and sum(r.step == "load_total" for r in log) == 2
    # nor is that of other lines
    monkeypatch.setattr(load.w, "f_sales", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        run_load(spark, settings)
    monkeypatch.setattr(load.w, "f_sales", fact)
    write(tmp_path / "a.csv", of_year(2016, 21))
    assert run_load(spark, settings)
    assert spark.table("mart8.f_sales").count() == 21


# ---- rejected lines -------------------------------------------------------------


def test_lines_that_cannot_be_read_are_kept_aside(spark, tmp_path):
    folder = tmp_path / "lines in parts"
    folder.mkdir()
    good = [row(i) for i in range(4)]
    broken = [row(4, **{"Product Name": 'Two\nline "name"'}), row(5, Sales="12,5x"), row(6, Quantity="3.0"), row(7, Quantity="2.5", Profit="?")]
    write(folder / "a.csv", good)
    write(folder / "b.csv", [*broken, row(8, **{"Ship Date": "never"}), row(9, Sales="")])
    with open(folder / "c.csv", "w", encoding="latin-1") as out:
        out.write(",".join(HEADER) + "\n10,O-5,1/2/2016\n")
    assert [f.rpartition("/")[2] for f in files_with_breaks(spark, str(folder))] == ["b.csv"]
    lines = {r["Row ID"]: r for r in read_order_lines(spark, str(folder)).collect()}
    assert sorted(lines, key=int) == ["0", "1", "2", "3", "4", "6", "8", "9"]
    assert lines["4"]["Product Name"] == 'Two\nline "name"' and lines["6"]["Quantity"] == 3 and lines["9"]["Sales"] is None
    assert run_load(spark, LoadSettings(str(folder), dt.date(2020, 1, 1), "raw9", "mart9"))
    rejected = spark.table("raw9.order_lines_rejected").collect()
    assert sorted((r.step, r.file.rpartition("/")[2], r.reason) for r in rejected) == [
        ("extract", "b.csv", "unreadable quantity, profit"), ("extract", "b.csv", "unreadable sales"),
        ("extract", "c.csv", "number of fields"), ("transform", "b.csv", "unreadable ship_date"),
    ]
    assert any("12,5x" in r.record for r in rejected) and any("10,O-5" in r.record for r in rejected)
    log = {r.step: r for r in spark.table("mart9.etl_log").collect()}
    assert (log["rejects"].status, log["rejects"].rows_affected) == ("WARN", 4)
    assert log["reconcile"].message == "DISCREPANCIA: f_sales=7 vs source=11; raw=7 vs source=11"
    names = {r.product_name for r in spark.table("mart9.d_product").collect()}
    assert 'Two line "name"' in names or 'Pen, 5" "fine"' in names


# ---- caches ---------------------------------------------------------------------


def test_a_model_of_changed_files_is_fitted_anew(spark, tmp_path):
    copy = tmp_path / "tables"
    shutil.copytree(FOLDER, copy)
    src = ParquetTables(spark, str(copy))
    calls = []
    for _ in range(2):
        registry._once(src, "probe", lambda: calls.append(1) or len(calls))
    assert registry._once(src, "probe", lambda: calls.append(1) or len(calls)) == 1
    lines = spark.read.parquet(f"{copy}/lineitem.parquet").filter("l_linenumber > 1")
    lines.write.parquet(str(tmp_path / "fewer"))
    (copy / "lineitem.parquet").unlink()
    shutil.copytree(tmp_path / "fewer", copy / "lineitem.parquet")
    assert registry._once(src, "probe", lambda: calls.append(1) or len(calls)) == 2
    assert len([k for k in registry._made if k[2] == "probe"]) == 1


def test_a_view_is_dropped_with_its_stamp(spark):
    calls, stamp = [], [1]
    view = store.CachedView(lambda: calls.append(1) or spark.range(2), lambda: stamp[0])
    assert view.get().count() == view.get().count() == 2 and len(calls) == 1
    stamp[0] = 2
    assert view.get().count() == 2 and len(calls) == 2


# ---- distinct counts and aggregates ---------------------------------------------


def test_bitmaps_count_as_distinct_does(spark):
    df = spark.range(200_000).selectExpr("id * 7 % 70000 AS number", "id % 3 AS a", "id % 5 AS b").withColumn("z", history.F.lit(None).cast("int"))
    df = df.unionByName(spark.createDataFrame([(None, 0, 0, None), (0, 9, 9, 9)], df.schema))
    cells = distinct.distinct_cells(df, ["a", "b", "z"], "number", "seen")
    for keys in (["a"], ["b"], ["a", "b"], ["z"], []):
        wanted = df.filter("number is not null").groupBy(*keys).agg(history.F.count_distinct("number").alias("n"))
        found = distinct.roll_up(cells, keys, "seen", "n")
        assert Counter(tuple(r) for r in found.collect()) == Counter(tuple(r) for r in wanted.collect())
        assert "Expand" not in plan(found)


def test_the_aggregate_answers_what_it_covers(spark):
    source = ParquetTables(spark, FOLDER)
    cells = registry._cells(source)
    for metric, within in (
        (sales.by_category, None), (sales.by_region, Slice(year=1997)), (profitability.by_region_category, Slice("ASIA", 1996)),
        (timeline.monthly_sales, None), (timeline.mom_last, Slice("EUROPE")),
    ):
        found = compute(metric, cells, within)
        assert "lineitem" not in plan(found) and "Expand" not in plan(found)
        assert found.collect() == compute(metric, source, within).collect()
    assert "lineitem" not in plan(cells.region_category())
    assert cells.region_category().collect() == compute(sales.region_category, source).collect()
    # by segment, or by day, it has no answer
    assert "lineitem" in plan(compute(sales.by_segment, cells)) and "lineitem" in plan(compute(sales.by_region, cells, Slice(segment="BUILDING")))
    assert compute(sales.by_segment, cells).collect() == compute(sales.by_segment, source).collect()
    with pytest.raises(ValueError, match="city"):
        cells.orders_by("city")


def test_stored_star_is_the_star(spark):
    for name in ("star_join_stored", "ship_modes_stored"):
        problem, rows = compare(entry.queries()[name](spark, FOLDER), connect(FOLDER), entry.oracle_sql()[name])
        assert problem is None and rows > 0


def test_random_lines_have_orders_in_many_categories(spark):
    book = random_lines(spark).withColumn("order_number", history.F.expr("cast(substring(order_id, 2) AS bigint)"))
    cells = w.order_cells(book)
    wanted = {r.category: r.n for r in book.groupBy("category").agg(history.F.count_distinct("order_id").alias("n")).collect()}
    assert {r.category: r.n for r in distinct.roll_up(cells, ["category"], "orders", "n").collect()} == wanted
