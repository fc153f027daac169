"""What a task holds does not grow with the input, and lines are not moved or read more often than needed."""

from __future__ import annotations

import random

import pytest
from lines import random_lines
from pyspark.sql import functions as F

from tillstar import session
from tillstar.operators import distinct
from tillstar.plans import profit_model, registry, segments

FOLDER = "/root/testdata/sf0.001"


def tree(df) -> str:
    """The plan, from the result down."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def untouched(spark):
    """Settings of the session as they were."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold")
    before = {key: spark.conf.get(key) for key in keys}
    yield
    session.size_tasks(spark, 0)
    for key, value in before.items():
        spark.conf.set(key, value)


def test_tasks_grow_in_number_with_the_input(spark, untouched):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    session.size_tasks(spark, 1000 * session.INPUT_BYTES)
    assert spark.conf.get(session._INITIAL) == "1000"
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == f"{session.FILE_BYTES}b"
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "1m"  # smaller than asked for
    session.size_tasks(spark, session.INPUT_BYTES)
    assert spark.conf.get(session._INITIAL, None) is None


def test_a_query_sizes_its_tasks(spark, untouched, monkeypatch):
    monkeypatch.setattr(session, "INPUT_BYTES", 2**10)
    rows = {tuple(r) for r in registry.run("q1_region_category", spark, FOLDER).collect()}
    assert int(spark.conf.get(session._INITIAL)) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.undo()
    assert {tuple(r) for r in registry.run("q1_region_category", spark, FOLDER).collect()} == rows


def test_numbers_meet_before_their_bitmap(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice(["x", None]), rng.choice([None, rng.randrange(200_000)])) for _ in range(500)]
    cells = distinct.distinct_cells(spark.createDataFrame(rows, "k string, l string, number bigint"), ["k", "l"], "number", "seen")
    steps = [line.split("(")[0].strip(" +-:*") for line in tree(cells).splitlines()]
    first = next(i for i, line in enumerate(tree(cells).splitlines()) if "bitmap_construct_agg" in line)
    last = max(i for i, line in enumerate(tree(cells).splitlines()) if "bitmap_construct_agg" in line)
    assert first < last and not any("Exchange" in step for step in steps[first:last])
    found = {r["k"]: r["n"] for r in distinct.roll_up(cells, ["k"], "seen", "n").collect()}
    assert found == {k: len({n for a, _, n in rows if a == k and n is not None}) for k in "ab"}


def test_customers_are_made_in_one_pass_over_the_lines(spark):
    base = segments.rfm_base(random_lines(spark))
    assert "ExistingRDD" not in tree(base)  # the lines' frame
    assert base.count() == 40


def test_weights_do_not_move_the_lines(spark, untouched):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = profit_model.training_rows(random_lines(spark))
    model = profit_model.fit(random_lines(spark))
    text = tree(model.predict(rows, "value"))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "Exchange hashpartitioning" not in text


def test_check_adds_lines_up_before_it_splits_them(spark):
    frame = random_lines(spark)
    model, rows = profit_model.fit(frame), profit_model.training_rows(frame)
    checked = profit_model.check(model, rows)
    text = tree(checked)
    assert "HashAggregate" in text[text.index("Generate") :]
    found = {(r["feature"], r["level"]): r["lines"] for r in checked.collect()}
    wanted = {(c, None): rows.count() for c in profit_model.NUMBERS}
    for c in profit_model.CATEGORIES:
        wanted |= {(c, r[c]): r["n"] for r in rows.groupBy(c).agg(F.count("*").alias("n")).collect()}
    assert found == wanted
    assert checked.filter("not orthogonal").count() == 0
