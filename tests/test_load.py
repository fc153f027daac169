from __future__ import annotations

import csv
import datetime as dt
import glob

import pytest

from tillstar.operators.metric import compute
from tillstar.plans import overview
from tillstar.plans import warehouse as w
from tillstar.plans.load import LoadSettings, key_violations, run_load
from tillstar.session import discard, settle, shared_dir
from tillstar.sources import store
from tillstar.sources.rawcsv import read_dated_lines, read_order_lines
from tillstar.sources.tables import StarTables

HEADER = [
    "Row ID", "Order ID", "Order Date", "Ship Date", "Ship Mode", "Customer ID", "Customer Name", "Segment", "Country",
    "City", "State", "Postal Code", "Region", "Product ID", "Category", "Sub-Category", "Product Name", "Sales",
    "Quantity", "Discount", "Profit",
]


def row(i, **changes):
    values = {
        "Row ID": i, "Order ID": f"O-{i // 2}", "Order Date": f"{i % 28 + 1}/{i % 12 + 1}/2016", "Ship Date": "31/12/2016",
        "Ship Mode": "First", "Customer ID": f"C-{i % 3}", "Customer Name": f"  Name \t {i % 3} ", "Segment": "Consumer",
        "Country": "US", "City": "Austin", "State": "Texas", "Postal Code": f"0{i % 2}123", "Region": "South",
        "Product ID": f"P-{i % 4}", "Category": "Office", "Sub-Category": "Art", "Product Name": 'Pen, 5" "fine"',
        "Sales": "10.5", "Quantity": 2, "Discount": "0.2", "Profit": "-1.25",
    }
    return {**values, **changes}


def write(path, rows, header=HEADER):
    with open(path, "w", encoding="latin-1", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(header)
        writer.writerows([[r[h] for h in HEADER] for r in rows])
    return str(path)


def standard_rows():
    rows = [row(i) for i in range(12)]
    rows.append(row(12, **{"Order Date": "99/99/2014"}))
    rows.append(row(13, **{"Customer Name": "José  Ruiz", "Customer ID": "C-9", "Order ID": "O-9", "Order Date": "8/1/2016"}))
    return rows


def test_reading_keeps_text_and_types(spark, tmp_path):
    path = write(tmp_path / "a.csv", standard_rows())
    lines = read_order_lines(spark, path)
    assert lines.columns == HEADER and lines.count() == 14
    first = lines.filter("`Row ID` = '0'").first()
    assert first["Postal Code"] == "00123" and first["Product Name"] == 'Pen, 5" "fine"'
    assert str(first["Sales"]) == "10.5000" and first["Quantity"] == 2
    assert lines.filter("`Customer ID` = 'C-9'").first()["Customer Name"] == "José  Ruiz"
    with pytest.raises(Exception, match="(?i)parse|date"):
        read_dated_lines(spark, path).collect()
    good = write(tmp_path / "b.csv", [r for r in standard_rows() if r["Order Date"] != "99/99/2014"])
    assert {r[0].year for r in read_dated_lines(spark, good).select("Order Date").collect()} == {2016}


def test_full_load_twice(spark, tmp_path):
    settings = LoadSettings(write(tmp_path / "a.csv", standard_rows()), dt.date(2020, 1, 1), "raw1", "mart1")
    assert run_load(spark, settings)
    table = lambda name: spark.table(f"mart1.{name}")
    assert spark.table("raw1.order_lines").count() == 14
    clean = spark.table("raw1.order_lines_clean")
    assert clean.count() == 13
    assert {r[0] for r in clean.select("customer_name").distinct().collect()} == {"Name 0", "Name 1", "Name 2", "José Ruiz"}
    assert table("f_sales").count() == 13 and table("d_customer").count() == 4 and table("d_location").count() == 2
    assert {r[0] for r in table("f_sales").select("location_sk").collect()} == {2}  # last of two postal codes
    assert dict(table("f_sales").dtypes)["sales"] == "decimal(12,4)"
    star = StarTables.from_catalog(spark, "mart1")
    assert star.view().count() == 13
    assert w.foreign_key_report(star.tables).filter("orphan_rows > 0").count() == 0
    assert compute(overview.kpis, star).first()["total_sales"] == pytest.approx(13 * 10.5)
    assert table("agg_sales_monthly").count() == 12
    by_year = w.from_monthly(table("agg_sales_monthly"), "year").first()
    assert (float(by_year["total_sales"]), by_year["transaction_count"]) == (13 * 10.5, 13)
    with pytest.raises(ValueError, match="customer"):
        w.from_monthly(table("agg_sales_monthly"), "customer")
    log = {r["step"]: r for r in table("etl_log").collect()}
    assert log["reconcile"]["status"] == "WARN"  # one line has an unreadable date
    assert log["reconcile"]["message"] == "DISCREPANCIA: f_sales=13 vs source=14; raw=13 vs source=14"
    assert log["constraints"]["status"] == "OK" and table("key_violations").count() == 0
    assert log["d_date"]["rows_affected"] == table("d_date").count()
    health = store.health(spark, "mart1").first()
    assert (health["fact_rows"], health["last_step"], health["status"]) == (13, "load_total", "healthy")

    # next day: one customer changes segment, one product name changes, one customer is new
    rows = standard_rows()
    for r in rows:
        if r["Customer ID"] == "C-1":
            r["Segment"] = "Corporate"
        if r["Product ID"] == "P-2":
            r["Product Name"] = "Pencil"
    rows.append(row(14, **{"Customer ID": "C-new", "Order ID": "O-14"}))
    again = LoadSettings(write(tmp_path / "b.csv", rows), dt.date(2020, 1, 2), "raw1", "mart1")
    assert run_load(spark, again)
    people = {(r["customer_id"], r["current_flag"]): r for r in table("d_customer").collect()}
    assert len(people) == 6
    assert people[("C-1", "N")]["expiration_date"] == dt.date(2020, 1, 2)
    assert people[("C-1", "Y")]["segment"] == "Corporate"
    assert {people[("C-1", "Y")]["customer_sk"], people[("C-new", "Y")]["customer_sk"]} == {5, 6}
    assert table("d_product").count() == 5
    star = StarTables.from_catalog(spark, "mart1")
    assert star.view("segment").filter("segment = 'Corporate'").count() == 4
    skip = LoadSettings(again.csv_path, dt.date(2020, 1, 3), "raw1", "mart1", skip_if_loaded=True)
    assert not run_load(spark, skip)


def test_a_load_leaves_no_intermediate_files(spark, tmp_path):
    left = lambda: set(glob.glob(shared_dir(spark).removeprefix("file:") + "/tillstar/*"))
    before = left()
    assert run_load(spark, LoadSettings(write(tmp_path / "a.csv", standard_rows()), dt.date(2020, 1, 1), "raw4", "mart4"))
    assert left() == before


def test_snake_case_header_and_key_violations(spark, tmp_path):
    header = [h.lower().replace(" ", "_").replace("-", "_") for h in HEADER]
    twice = [row(1), row(1)]
    settings = LoadSettings(write(tmp_path / "a.csv", twice, header), dt.date(2020, 1, 1), "raw2", "mart2")
    assert run_load(spark, settings)
    found = key_violations(StarTables.from_catalog(spark, "mart2")).collect()
    assert [tuple(r) for r in found] == [("f_sales", 2)]
    assert [tuple(r) for r in spark.table("mart2.key_violations").collect()] == [("f_sales", 2)]
    log = {r["step"]: r for r in spark.table("mart2.etl_log").collect()}
    assert (log["constraints"]["status"], log["constraints"]["rows_affected"]) == ("WARN", 1)


def test_failed_load_is_logged(spark, tmp_path):
    header = ["Wrong" if h == "Order ID" else h for h in HEADER]
    settings = LoadSettings(write(tmp_path / "a.csv", [row(1)], header), dt.date(2020, 1, 1), "raw3", "mart3")
    with pytest.raises(KeyError):
        run_load(spark, settings)
    log = spark.table("mart3.etl_log").collect()
    assert [(r["step"], r["status"]) for r in log] == [("extract", "ERROR")]


def test_replace_table_from_itself(spark):
    store.ensure_database(spark, "own")
    store.replace_table(spark.range(3), "own.t")
    store.replace_table(spark.table("own.t").filter("id > 0"), "own.t")
    assert sorted(r[0] for r in spark.table("own.t").collect()) == [1, 2]


def test_a_failing_job_keeps_the_old_table(spark):
    store.ensure_database(spark, "own")
    store.replace_table(spark.range(3).selectExpr("id", "id % 2 AS part"), "own.p", ["part"])
    bad = spark.range(3).selectExpr("id", "id / (id - id) AS part")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        store.replace_table(bad, "own.p", ["part"])
    assert spark.table("own.p").count() == 3


def test_cached_view_refreshes(spark):
    calls = []
    view = store.CachedView(lambda: calls.append(1) or spark.range(2))
    assert view.get().count() == view.get().count() == 2 and len(calls) == 1
    view.refresh()
    assert len(calls) == 2


def test_settle_writes_below_the_shared_folder(spark, tmp_path):
    class Conf:
        def get(self, key, default=None):
            return f"file://{tmp_path}/shared/" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert shared_dir(Session()) == f"file://{tmp_path}/shared"
    frame = settle(spark.range(3), "x")
    assert frame.count() == 3 and f"{shared_dir(spark)}/tillstar/x-" in frame.inputFiles()[0]


def test_without_a_configured_folder_the_warehouse_is_used():
    class Context:
        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return "hdfs://store/warehouse/" if key == "spark.sql.warehouse.dir" else default

    assert shared_dir(Session()) == "hdfs://store/warehouse/_work"


def test_discarded_frames_leave_no_files(spark):
    frame = settle(spark.range(3), "gone")
    discard(frame)
    with pytest.raises(Exception, match="(?i)not exist"):
        frame.count()
