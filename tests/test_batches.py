"""Histories take every buyer of the next batch."""

from __future__ import annotations

import datetime as dt

import pytest

from tillstar.plans import registry
from tillstar.sources.tables import TABLE_SCHEMAS


@pytest.fixture
def folder(spark, tmp_path):
    """Customer 7 buys before and after the cut, 14 after it only and 8 before it only."""
    early, late = dt.datetime(1996, 5, 1), dt.datetime(1998, 5, 1)
    rows = {
        "customer": [(7, "Ann", 0, 5.0, "A"), (8, "Bea", 0, 5.0, "A"), (14, "Cid", 0, 5.0, "B")],
        "orders": [(i, key, "O", 1.0, day, "x") for i, (key, day) in enumerate([(7, early), (8, early), (7, late), (14, late)])],
    }
    for name, values in rows.items():
        spark.createDataFrame(values, TABLE_SCHEMAS[name]).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_changes_know_every_buyer(spark, folder):
    found = {r["customer_id"]: r["status"] for r in registry.run("scd2_changes", spark, folder).collect()}
    assert found == {7: "unchanged", 8: "missing", 14: "new"}


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("scd2_apply", {(7, "Y"), (8, "Y"), (14, "Y")}),
        ("scd2_apply_expiring", {(7, "Y"), (8, "N"), (14, "Y")}),
        ("scd2_current", {(7, "Y"), (14, "Y")}),
    ],
)
def test_snapshots_know_every_buyer(spark, folder, name, expected):
    assert {(r["customer_id"], r["current_flag"]) for r in registry.run(name, spark, folder).collect()} == expected
