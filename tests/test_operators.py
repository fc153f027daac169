from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tillstar.operators import history, quality
from tillstar.operators.keyed import first_per_key, last_key, lookup_key
from tillstar.operators.months import month_spine, monthly_totals, trailing_mean
from tillstar.operators.ordered import with_dense_key, with_running_totals
from tillstar.plans.timeline import mom_change, mom_last, with_features


def test_running_totals_over_many_slices_with_ties(spark):
    rng = random.Random(1)
    rows = [(f"m{i:04d}", rng.choice([0, 0, 0, 5, 9])) for i in range(2000)]
    frame = spark.createDataFrame(rows, "member string, v bigint").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = with_running_totals(
            frame, [F.desc("v"), F.asc("member")], {"so_far": "v"}, size="n", totals={"whole": "v"}
        )
        got = sorted(numbered.collect(), key=lambda r: r["position"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    ordered = sorted(rows, key=lambda r: (-r[1], r[0]))
    running = 0
    for place, ((member, v), row) in enumerate(zip(ordered, got), 1):
        running += v
        assert (row["position"], row["member"], row["so_far"]) == (place, member, running)
        assert (row["n"], row["whole"]) == (len(rows), sum(v for _, v in rows))
    assert len(got) == len(rows)


def test_running_totals_of_nothing(spark):
    empty = spark.createDataFrame([], "member string, v bigint")
    assert with_running_totals(empty, [F.asc("member")], {"so_far": "v"}).count() == 0


def test_dense_keys_continue_from_start(spark):
    frame = spark.createDataFrame([("c",), ("a",), ("b",)], "k string")
    assert {(r["sk"], r["k"]) for r in with_dense_key(frame, "sk", ["k"], start=5).collect()} == {
        (5, "a"), (6, "b"), (7, "c")
    }


def test_first_per_key_is_deterministic(spark):
    rows = [(1, "late", 9), (1, "early", 2), (2, None, 1), (2, "x", 5), (3, "b", 4), (3, "a", 4)]
    frame = spark.createDataFrame(rows, "k int, name string, at int")
    for parts in (1, 5):
        got = {r["k"]: r["name"] for r in first_per_key(frame.repartition(parts), ["k"], ["name"], "at").collect()}
        assert got == {1: "early", 2: None, 3: "a"}


def test_lookup_maps_unknown_and_null_to_one(spark):
    fact = spark.createDataFrame([("a",), ("z",), (None,)], "id string")
    dim = spark.createDataFrame([("a", 7)], "dim_id string, sk bigint")
    got = {r["id"]: r["sk"] for r in lookup_key(fact, dim, {"id": "dim_id"}, "sk").collect()}
    assert got == {"a": 7, "z": 1, None: 1}
    assert {r["sk"] for r in lookup_key(fact, dim, {"id": "dim_id"}, "sk", unknown=-1).collect()} == {7, -1}


def test_last_key_wins_on_composite_duplicates(spark):
    dim = spark.createDataFrame([("x", "s", 1), ("x", "s", 4), ("x", "t", 2)], "city string, state string, sk int")
    assert {tuple(r) for r in last_key(dim, ["city", "state"], "sk").collect()} == {("x", "s", 4), ("x", "t", 2)}


def months(spark, count, skip=()):
    rows = [
        (dt.date(2014 + i // 12, i % 12 + 1, 15), float(100 + i)) for i in range(count) if i not in skip
    ]
    return spark.createDataFrame(rows, "order_date date, sales double").withColumn(
        "sales", F.col("sales").cast("decimal(12,4)")
    )


def test_monthly_series_fills_gaps(spark):
    got = monthly_totals(months(spark, 14, skip=(4, 5)), ["sales"]).orderBy("month_end").collect()
    assert [float(r["sales"]) for r in got] == [100, 101, 102, 103, 0, 0, *range(106, 114)]
    assert got[0]["month_end"] == dt.date(2014, 1, 31) and got[-1]["month_end"] == dt.date(2015, 2, 28)


def test_monthly_series_per_partition(spark):
    frame = months(spark, 3).withColumn("region", F.lit("a")).unionByName(
        months(spark, 5, skip=(0, 1, 3)).withColumn("region", F.lit("b"))
    )
    got = monthly_totals(frame, ["sales"], partition_by=["region"]).orderBy("region", "month_end").collect()
    assert [(r["region"], float(r["sales"])) for r in got] == [
        ("a", 100), ("a", 101), ("a", 102), ("b", 102), ("b", 0), ("b", 104)
    ]


def test_trailing_mean_needs_one_value(spark):
    got = monthly_totals(months(spark, 4), ["sales"]).select("month_end", trailing_mean("sales").alias("ma"))
    assert [r["ma"] for r in got.orderBy("month_end").collect()] == [100.0, 100.5, 101.0, 102.0]


def test_month_spine_reaches_into_the_future(spark):
    got = month_spine(months(spark, 2), ahead=2).orderBy("month_end").collect()
    assert [tuple(r) for r in got] == [
        (dt.date(2014, 1, 31), False), (dt.date(2014, 2, 28), False),
        (dt.date(2014, 3, 31), True), (dt.date(2014, 4, 30), True),
    ]


def test_month_over_month(spark):
    changes = mom_change(months(spark, 4, skip=(1,))).orderBy("month").collect()
    assert [r["mom_pct"] for r in changes][:3] == [None, -100.0, None]
    last = mom_last(months(spark, 2)).first()
    assert (last["current_month"], last["prev_month"], last["mom_pct"], last["mom_trend"]) == (
        "Feb 2014", "Jan 2014", 1.0, "pos"
    )
    assert mom_last(months(spark, 1)).count() == 0


def test_features_back_fill_lags(spark):
    features = with_features(monthly_totals(months(spark, 14), ["sales"]), "sales").orderBy("t").collect()
    assert [r["lag_1"] for r in features][:3] == [100.0, 100.0, 101.0]
    assert [r["lag_12"] for r in features] == [100.0] * 13 + [101.0]
    short = with_features(monthly_totals(months(spark, 12), ["sales"]), "sales").collect()
    assert {r["lag_12"] for r in short} == {None}


# ---- history ---------------------------------------------------------------------


def customers(spark, *rows):
    return spark.createDataFrame(rows, "customer_id string, customer_name string, segment string")


def snapshot(df):
    return sorted(
        (r["customer_sk"], r["customer_id"], r["segment"], str(r["effective_date"]), str(r["expiration_date"]), r["current_flag"])
        for r in df.collect()
    )


def test_history_over_three_runs(spark):
    tracked = ["customer_name", "segment"]
    days = [dt.date(2020, 1, d) for d in (1, 2, 3)]
    first = history.first_versions(
        customers(spark, ("a", "A", "x"), ("b", None, "x"), ("c", "C", "x")), "customer_sk", "customer_id", tracked, days[0]
    )
    batch = customers(spark, ("a", "A", "y"), ("b", None, "x"), ("d", "D", "x"))
    second = history.apply_versions(first, batch, "customer_sk", "customer_id", tracked, days[1])
    assert snapshot(second) == [
        (1, "a", "x", "2020-01-01", "2020-01-02", "N"),
        (2, "b", "x", "2020-01-01", "None", "Y"),
        (3, "c", "x", "2020-01-01", "None", "Y"),
        (4, "a", "y", "2020-01-02", "None", "Y"),
        (5, "d", "x", "2020-01-02", "None", "Y"),
    ]
    # nothing new: idempotent, the null name included
    assert snapshot(history.apply_versions(second, batch, "customer_sk", "customer_id", tracked, days[2])) == snapshot(second)
    third = history.apply_versions(second, batch, "customer_sk", "customer_id", tracked, days[2], expire_missing=True)
    assert (3, "c", "x", "2020-01-01", "2020-01-03", "N") in snapshot(third)
    current = history.current(third).groupBy("customer_id").count().collect()
    assert {r["count"] for r in current} == {1}
    assert [r[0] for r in history.missing_keys(second, batch, "customer_id").collect()] == ["c"]
    assert history.next_key(third, "customer_sk") == 6
    assert history.next_key(third.limit(0), "customer_sk") == 1


# ---- quality -----------------------------------------------------------------------


def test_key_reports(spark):
    fact = spark.createDataFrame([(1, 1), (1, 2), (2, 9), (2, 9), (None, 9)], "a int, b int")
    dim = spark.createDataFrame([(1,), (3,)], "k int")
    report = quality.orphan_report(fact, {"a": ("a", dim, "k"), "b": ("b", dim, "k")}).collect()
    assert sorted(tuple(r) for r in report) == [("a", 4, 2, 1), ("b", 5, 4, 2)]
    repeats = quality.duplicate_report({"fact": (fact, ["a", "b"]), "dim": (dim, ["k"])}).collect()
    assert [tuple(r) for r in repeats] == [("fact", 1, 2), ("dim", 0, 0)]


@pytest.mark.parametrize(
    ("fact", "clean", "source", "status", "message"),
    [
        (3, 3, 3, "OK", "OK: f_sales=3, raw=3, source=3"),
        (2, 3, 3, "WARN", "DISCREPANCIA: f_sales=2 vs source=3"),
        (2, 1, 3, "WARN", "DISCREPANCIA: f_sales=2 vs source=3; raw=1 vs source=3"),
    ],
)
def test_reconcile(spark, fact, clean, source, status, message):
    row = quality.reconcile(spark.range(fact), spark.range(clean), source).first()
    assert (row["status"], row["message"]) == (status, message)
