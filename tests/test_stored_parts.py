"""The stored star part by part: what exchanges of the lines leave on disk goes with the part."""

from __future__ import annotations

import re
import time
from collections import Counter
from pathlib import Path

from check_oracle import compare, connect
from tillstar import oracle
from tillstar.plans import registry

FOLDER = "/root/testdata/sf0.001"


def exchanged(spark) -> dict[str, int]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f: Path(f).stat().st_size for f in files if re.search(r"shuffle_.*\.data$", f) and Path(f).exists()}


def test_stored_tables_leave_no_exchange_of_the_lines(spark):
    before = exchanged(spark)
    view = registry.run("star_join_stored", spark, FOLDER)
    until = time.time() + 20
    lines = Path(FOLDER, "lineitem.parquet").stat().st_size
    while (left := sum(n for f, n in exchanged(spark).items() if f not in before)) > lines / 4 and time.time() < until:
        time.sleep(0.2)
    assert left <= lines / 4
    assert view.count() == 6000


def test_parts_are_the_whole_star(spark, monkeypatch, most=4):
    whole = Counter(tuple(r) for r in registry.run("star_join_stored", spark, FOLDER).collect())
    monkeypatch.setattr(registry, "BUCKET_BYTES", 1024)
    monkeypatch.setattr(registry, "MOST_PARTS", most)
    written = []
    monkeypatch.setattr(registry, "settle", lambda df, label: written.append(label) or SETTLE(df, label))
    assert Counter(tuple(r) for r in registry.run("star_join_stored", spark, FOLDER).collect()) == whole
    assert written == ["stored-view"] * most
    for name in ("star_join_stored", "ship_modes_stored"):
        problem, rows = compare(registry.run(name, spark, FOLDER), connect(FOLDER), oracle.SQL[name])
        assert problem is None and rows > 0


def test_lines_of_a_part_do_not_move_to_their_orders(spark, monkeypatch):
    monkeypatch.setattr(registry, "BUCKET_BYTES", 1024)
    star = registry._StoredStar(registry.ParquetTables(spark, FOLDER))
    assert len(star.parts) == registry.MOST_PARTS
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = star.parts[0].view("order_id", "ship_mode", "sales")
        text = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "Exchange" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    orders = [part.tables["f_sales"].select("order_id").distinct().count() for part in star.parts]
    assert sum(orders) == star.view("order_id").distinct().count() and min(orders) > 0


SETTLE = registry.settle
