from __future__ import annotations

import datetime as dt

import pytest
from lines import Flat, lines, random_lines
from pyspark.sql import functions as F

from tillstar.operators.metric import compute
from tillstar.operators.slices import Slice
from tillstar.plans import customers, exports, overview, pareto, profitability, sales, shipping, timeline
from tillstar.plans import warehouse as w
from tillstar.sources.tables import StarTables


@pytest.fixture(scope="module")
def book(spark):
    return random_lines(spark).persist()


def test_totals_agree_across_breakdowns(spark, book):
    whole = book.agg(F.sum("sales")).first()[0]
    for breakdown in (sales.by_category, sales.by_region, sales.by_segment):
        assert sum(r["sales"] for r in compute(breakdown, Flat(book)).collect()) == pytest.approx(float(whole))
    profit = float(book.agg(F.sum("profit")).first()[0])
    assert sum(r["profit"] for r in profitability.discount_tiers(book).collect()) == pytest.approx(profit)
    assert sum(r["transactions"] for r in profitability.discount_tiers(book).collect()) == book.count()


def test_kpis_over_nothing(spark, book):
    row = overview.kpis(book.limit(0)).first()
    assert (row["total_sales"], row["total_orders"], row["margin"], row["total_sales_fmt"]) == (0.0, 0, 0.0, "$0")
    assert row["avg_qty_per_order"] is None


def yoy(spark, years, **options):
    frame = lines(
        spark,
        *[{"order_id": f"{y}-{i}", "order_date": dt.date(y, 5, 1), "sales": s} for y, vs in years.items() for i, s in enumerate(vs)],
    )
    return overview.kpi_yoy(frame, **options).first()


def test_year_over_year_modes(spark):
    years = {2014: [50.0], 2016: [100.0], 2017: [150.0, 150.0]}
    row = yoy(spark, years)
    assert (row["sales"], row["prev_sales"], row["yoy_sales"], row["yoy_orders"]) == (300.0, 100.0, 200.0, 100.0)
    row = yoy(spark, years, mode="reference")
    assert (row["sales"], row["prev_sales"], row["orders"]) == (450.0, 100.0, 4)
    row = yoy(spark, years, within=Slice(year="2016"))
    assert (row["sales"], row["prev_sales"], row["yoy_sales"], row["sales_trend"]) == (100.0, 0.0, None, "neutral")


def test_year_over_year_with_one_year(spark):
    row = yoy(spark, {2016: [100.0]})
    assert (row["sales"], row["prev_sales"], row["yoy_sales"], row["yoy_margin"]) == (100.0, 0.0, None, row["margin"])


def test_alert_scopes(spark):
    frame = lines(
        spark,
        {"region": "South", "segment": "Consumer", "sales": 100.0, "profit": 5.0},
        {"region": "West", "segment": "Corporate", "category": "Technology", "sales": 100.0, "profit": 40.0},
        {"region": "West", "segment": "Consumer", "category": "Technology", "discount": 0.6, "sales": 100.0, "profit": -20.0},
    )
    row = overview.alerts(frame, Slice(region="West", segment="Consumer")).first()
    assert (row["discount_loss"], row["discount_band"]) == (-20.0, "red")
    assert (row["region_margin"], row["region_band"]) == (5.0, "amber")
    assert row["category_margin"] == 10.0  # both segments of the region


def test_quantity_mean_is_per_order(spark):
    frame = lines(spark, {"quantity": 1}, {"quantity": 4}, {"order_id": "o2", "quantity": 2})
    assert tuple(overview.quantity_stats(frame).first()) == (7, 3.5)


def test_filter_values_start_with_all(spark, book):
    got = [(r["filter_name"], r["value"]) for r in overview.filter_values(book).collect()]
    assert [v for f, v in got if f == "region"] == ["Todas", "Central", "East", "South", "West"]
    assert [v for f, v in got if f == "year"][0] == "Todos"


def test_state_lookup_drops_unknown_states(spark, book):
    lookup = sales.state_lookup(spark)
    assert lookup.count() == 49
    got = {r["state"]: r["abbr"] for r in sales.by_state(book, lookup).collect()}
    assert got == {"Texas": "TX", "Ohio": "OH", "Maine": "ME"}


def test_empty_tiers_are_zero(spark):
    got = profitability.discount_tiers(lines(spark, {"discount": 0.3})).collect()
    assert [(r["tier"], r["transactions"], r["profit_fmt"]) for r in got] == [
        ("Sin desc.", 0, "$0"), ("≤20%", 0, "$0"), ("≤50%", 1, "$10"), (">50%", 0, "$0")
    ]


def test_zero_sales_margins(spark):
    frame = lines(spark, {"sales": 0.0, "profit": -5.0})
    assert overview.top_products(frame).first()["margin"] == 0.0  # scalar path
    assert sales.top_products(frame).first()["margin"] is None  # column path
    assert customers.segment_cards(frame).first()["margin"] == 0.0


def test_heatmap(spark):
    frame = lines(spark, {"segment": "B", "profit": 1.0}, {"segment": "A", "profit": 10.0}, {"region": "West", "category": "X"})
    by_sum = {(r["region"], r["category"]): r["profit"] for r in profitability.heatmap(frame).collect()}
    assert by_sum[("South", "Office")] == 11.0
    wide = {r["region"]: (r["Office"], r["X"]) for r in profitability.heatmap_wide(profitability.heatmap(frame), ["Office", "X"]).collect()}
    assert wide == {"South": (11.0, 0.0), "West": (0.0, 10.0)}


def test_frequency_bins(spark):
    counts = {"a": 1, "b": 2, "c": 5, "d": 10, "e": 50, "f": 51}
    frame = lines(spark, *[{"customer_name": k, "order_id": f"{k}{i}"} for k, v in counts.items() for i in range(v)])
    assert [r["customers"] for r in customers.frequency(frame).collect()] == [1, 1, 1, 1, 2]


def test_insight(spark):
    frame = lines(
        spark,
        {"customer_name": "A", "segment": "x", "order_id": "1", "sales": 10.0},
        {"customer_name": "A", "segment": "x", "order_id": "2", "sales": 10.0},
        {"customer_name": "B", "segment": "y", "order_id": "3", "sales": 70.0},
    )
    assert tuple(customers.insight(frame).first()) == ("y", "$70", "$30", 2, 50.0)
    assert customers.insight(frame.limit(0)).count() == 0


def test_shipping_ignores_undelivered(spark):
    day = dt.date(2016, 1, 1)
    frame = lines(
        spark,
        {"ship_date": day + dt.timedelta(days=2)}, {"ship_date": day + dt.timedelta(days=9)}, {"ship_date": None},
    )
    assert tuple(shipping.stats(frame).first()) == (5.5, 50.0, 2)
    row = shipping.by_mode(frame).first()
    assert (row["avg_days"], row["avg_whole_days"], row["orders"], row["std_days"]) == (5.5, 5, 2, 4.9)


@pytest.mark.parametrize(
    ("size", "fifth", "cut"), [(3, 1, 100.0), (19, 3, 31.6), (20, 4, 15.0), (25, 5, 16.0)]
)
def test_pareto_cut(spark, size, fifth, cut):
    frame = lines(spark, *[{"product_name": f"p{i:02d}", "sales": float(100 - i)} for i in range(size)])
    row = pareto.product_summary(frame).first()
    assert (row["total_products"], row["top20_products_count"], row["pct_products_at_cut"]) == (size, fifth, cut)
    top = sum(100 - i for i in range(fifth)) / sum(100 - i for i in range(size)) * 100
    assert row["top20_revenue_share"] == pytest.approx(top, abs=0.051)
    curve = pareto.products(frame).orderBy("position").collect()
    assert curve[-1]["cum_pct"] == pytest.approx(100.0) and curve[-1]["product_pct"] == 100.0


def test_star_gives_the_same_metrics_as_the_flat_lines(spark, book):
    flat = book.withColumn("postal_code", F.lit("00001"))
    star = StarTables(w.build_star(Flat(flat), dt.date(2020, 1, 1)))
    for function in (
        overview.kpis, sales.by_region, sales.by_city, sales.top_products, sales.region_category,
        profitability.by_region_category, shipping.kpis_by_region, timeline.monthly_trend, overview.top_products,
        shipping.mode_impact, pareto.product_summary,
    ):
        mine = sorted(map(str, compute(function, star, Slice(year=2016)).collect()))
        flat_rows = sorted(map(str, compute(function, Flat(book), Slice(year=2016)).collect()))
        assert mine == flat_rows, function.__name__


def test_a_small_slice_is_answered_as_it_is(spark, book):
    assert compute(timeline.monthly_trend, Flat(book), Slice(region="Atlantis")).count() == 0
    assert compute(timeline.monthly_trend, Flat(book), Slice(year=2016)).count() == 12


def test_headline_counts_all_lines_beside_the_slice(spark):
    frame = lines(spark, {"region": "East"}, {"region": "West"}, {"region": "West", "order_id": "o9"})
    row = overview.headline(Flat(frame), Slice(region="East")).first()
    assert (row["total_orders"], row["total_fact_rows"]) == (1, 3)


def test_reports_have_no_line_for_an_unknown_member(spark):
    frame = lines(spark, {"category": None, "region": None, "customer_name": None, "segment": None, "ship_mode": None, "state": None, "product_name": None}, {})
    for report in (
        sales.by_category, sales.by_region, sales.by_segment, sales.by_city, sales.top_products, overview.units_by_category,
        overview.top_products, customers.segment_cards, customers.segment_margin, customers.top_customers,
        profitability.by_region_category, profitability.heatmap, shipping.mode_impact,
    ):
        rows = report(frame).collect()
        assert len(rows) == 1 and None not in tuple(rows[0])[:1], report.__name__


def test_export_modules(spark, book, tmp_path):
    source = Flat(book)
    sheets = {m: set(exports.sheets(source, m)) for m in ("overview", "sales", "profitability", "customers", "shipping")}
    assert sheets["overview"] == {"kpis", "top_products", "pareto", "monthly"}
    assert sum(map(len, sheets.values())) == 19
    for module in sheets:
        for path in exports.export_module(source, module, str(tmp_path), Slice(year=2016)):
            assert spark.read.option("header", True).csv(path).count() > 0
    with pytest.raises(KeyError):
        exports.sheets(source, "nothing")


def test_csv_export_keeps_every_row(spark, book, tmp_path):
    rows = exports.export_rows(Flat(book), Slice(region="West"))
    exports.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == rows.columns and back.count() == book.filter("region = 'West'").count()
