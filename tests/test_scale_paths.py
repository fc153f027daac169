"""The plans taken beyond the size checks give the same results."""

from __future__ import annotations

import datetime as dt

import pytest
from check_oracle import compare, connect

import __spark_entry__ as entry
from tillstar.operators.metric import compute
from tillstar.operators.slices import Slice
from tillstar.plans import overview, sales
from tillstar.plans import warehouse as w
from tillstar.sources import tables
from tillstar.sources.tables import ParquetTables, StarTables

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture
def large(spark, monkeypatch):
    """Size checks fail, and Spark broadcasts nothing by itself."""
    monkeypatch.setattr(tables, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(
    "name",
    [
        "kpis", "kpi_yoy", "filter_region_year_segment", "filter_coverage", "filter_values", "quantity_stats",
        "sales_by_region", "sales_by_category", "sales_by_city", "sales_by_state", "top_products_sales",
        "q1_region_category", "segment_cards", "segment_margin", "customer_insight", "customer_frequency",
        "monthly_trend", "pareto_products", "pareto_customers", "rfm_base", "fmt_money", "ship_mode_impact",
        "profit_region_category", "fact_unknown_keys", "scd2_apply", "agg_year_region",
    ],
)
def test_same_result_without_broadcast(spark, large, name):
    problem, _ = compare(entry.queries()[name](spark, FOLDER), connect(FOLDER), entry.oracle_sql()[name])
    assert problem is None


def test_lines_are_added_up_before_the_join(spark, large):
    text = plan(compute(sales.by_region, ParquetTables(spark, FOLDER)))
    assert "BroadcastHashJoin" not in text
    first_join = text.index("SortMergeJoin")
    assert "partial_sum" in text[first_join:]  # an aggregate below the join


def test_a_slice_meets_the_lines_before_they_are_added_up(spark, large):
    source = ParquetTables(spark, FOLDER)
    for df in (
        compute(overview.kpis, source, Slice("EUROPE", 1997, "BUILDING")), overview.year_on_year(source, Slice("EUROPE", 1997, "BUILDING")),
    ):
        text = plan(df)
        # the tree is printed from the result down: what is summed comes above the join with the orders
        tree = text[: text.index("(1) ")]
        assert tree.rindex("Aggregate") < tree.index("Join"), tree
        assert "o_orderdate" in text


def test_scan_reads_only_what_a_metric_needs(spark):
    text = plan(compute(sales.by_category, ParquetTables(spark, FOLDER)))
    assert "l_shipdate" not in text and "orders.parquet" not in text and "customer.parquet" not in text


def test_filters_reach_the_scan(spark):
    text = plan(compute(overview.kpis, ParquetTables(spark, FOLDER), Slice("EUROPE", 1997, "BUILDING")))
    assert "EqualTo(r_name,EUROPE)" in text and "EqualTo(c_mktsegment,BUILDING)" in text
    assert "GreaterThanOrEqual(o_orderdate" in text


def test_year_filter_prunes_fact_partitions(spark, tmp_path):
    star = w.build_star(ParquetTables(spark, FOLDER), dt.date(2020, 1, 1))
    path = str(tmp_path / "f_sales")
    star["f_sales"].write.partitionBy("order_year").parquet(path)
    stored = StarTables({**star, "f_sales": spark.read.parquet(path)})
    text = plan(compute(sales.by_region, stored, Slice(year=1997)))
    assert "dynamicpruning" in text.lower()
    whole = compute(sales.by_region, ParquetTables(spark, FOLDER), Slice(year=1997)).collect()
    assert compute(sales.by_region, stored, Slice(year=1997)).collect() == whole
