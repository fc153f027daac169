from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillstar.functions import numbers as n
from tillstar.functions.text import column_name, raw_date, squeeze, with_snake_names
from tillstar.operators.slices import Slice


def column(spark, values, kind, expression):
    frame = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in frame.select(expression(F.col("x"))).collect()]


def test_money_short_matches_python_formatting(spark):
    def expected(v):
        if abs(v) >= 1_000_000:
            return f"${v / 1_000_000:.1f}M"
        return f"${v / 1_000:.0f}K" if abs(v) >= 1_000 else f"${v:.0f}"

    values = [0.0, 0.5, 1.5, 2.5, 45.4, 999.5, 1000.0, 1500.0, 2500.0, -2500.0, 999_600.0, 1e6, 1.25e6, -3.75e6, 2e9]
    assert column(spark, values, "double", n.money_short) == [expected(v) for v in values]


def test_money_and_percent_text(spark):
    values = [1234.5, -1234.5, 0.125, 1e6]
    assert column(spark, values, "double", n.money) == [f"${v:,.0f}" for v in values]
    assert column(spark, values, "double", lambda c: n.money(c, 2)) == [f"${v:,.2f}" for v in values]
    assert column(spark, [12.0, 1234.5], "double", n.pct_text) == ["12.0%", "1234.5%"]
    assert column(spark, [3.25, -0.5], "double", n.days_text) == ["3.2d", "-0.5d"]


def test_ratios_with_zero_denominator(spark):
    row = spark.sql("select cast(1 as decimal(12,4)) a, cast(0 as decimal(12,4)) z, cast(8 as decimal(12,4)) b").select(
        n.pct(F.col("a"), F.col("z")), n.pct_or_zero(F.col("a"), F.col("z")), n.pct(F.col("a"), F.col("b")),
        n.change_pct(F.col("a"), F.col("z")), n.change_pct(F.col("b"), F.col("a")),
    ).first()
    assert tuple(row) == (None, 0.0, 12.5, None, 700.0)


def test_discount_tiers_at_the_cuts(spark):
    tiers = column(spark, [0.0, 0.1, 0.2, 0.3, 0.5, 0.8], "double", n.discount_tier)
    assert tiers == ["Sin desc.", "≤20%", "≤20%", "≤50%", "≤50%", ">50%"]
    exact = column(spark, ["0.2000", "0.2001"], "string", lambda c: n.discount_tier(c.cast("decimal(5,4)")))
    assert exact == ["≤20%", "≤50%"]


@pytest.mark.parametrize(
    ("band", "values", "labels"),
    [
        (n.margin_band, [-1.0, 0.0, 19.9, 20.0, None], ["red", "red", "amber", "green", None]),
        (n.region_margin_band, [7.9, 8.0], ["amber", "green"]),
        (n.on_time_band, [49.9, 50.0, 70.0], ["red", "amber", "green"]),
        (n.segment_margin_band, [11.9, 12.0], ["amber", "green"]),
        (n.lift_band, [1.4, 1.5], ["plain", "green"]),
        (n.fit_band, [0.29, 0.3, 0.6], ["bajo", "moderado", "bueno"]),
        (n.trend_sign, [-0.1, 0.0, None], ["neg", "pos", "neutral"]),
    ],
)
def test_bands(spark, band, values, labels):
    assert column(spark, values, "double", band) == labels


def test_clip_keeps_null(spark):
    assert column(spark, [-5.0, 0.5, 7.0, None], "double", lambda c: n.clip(c, 0.0, 1.0)) == [0.0, 0.5, 1.0, None]


def test_squeeze_collapses_every_kind_of_space(spark):
    dirty = ["  A \t B ", "A\u00a0 B", "\u00a0A\n B\u00a0", "AB", None]
    assert column(spark, dirty, "string", squeeze) == ["A B", "A B", "A B", "AB", None]


def test_raw_dates(spark):
    texts = ["8/1/2016", "08/11/2016", "99/99/2014", "", None]
    assert column(spark, texts, "string", raw_date) == [dt.date(2016, 1, 8), dt.date(2016, 11, 8), None, None, None]
    with pytest.raises(Exception, match="(?i)parse|date"):
        column(spark, ["99/99/2014"], "string", lambda c: raw_date(c, strict=True))


def test_column_name_and_snake_names(spark):
    frame = spark.createDataFrame([(1, 2)], "`Order ID` int, `Sub-Category` int")
    assert column_name(frame, "order_id", "Order ID") == "Order ID"
    with pytest.raises(KeyError):
        column_name(frame, "region", "Region")
    assert with_snake_names(frame).columns == ["order_id", "sub_category"]


def sales_frame(spark):
    rows = [
        ("North", dt.date(2016, 12, 31), "Consumer", 1),
        ("North", dt.date(2017, 1, 1), "Corporate", 2),
        ("South", dt.date(2017, 12, 31), "Consumer", 3),
        ("South", dt.date(2018, 1, 1), None, 4),
    ]
    return spark.createDataFrame(rows, "region string, order_date date, segment string, id int")


@pytest.mark.parametrize(
    ("within", "ids"),
    [
        (Slice(), [1, 2, 3, 4]),
        (Slice("Todas", "Todos", "Todos"), [1, 2, 3, 4]),
        (Slice("", "", ""), [1, 2, 3, 4]),
        (Slice(year="2017"), [2, 3]),
        (Slice("South", 2017), [3]),
        (Slice(segment="Consumer"), [1, 3]),
    ],
)
def test_slices(spark, within, ids):
    assert sorted(r["id"] for r in within.apply(sales_frame(spark)).collect()) == ids
