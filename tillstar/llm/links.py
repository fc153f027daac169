"""Links between rows: blocks compared piece by piece, and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstar.session import discard, settle

#: What comparing a pair of chunks reports for each row with a link in it.
LINKS = "id bigint, links bigint, root bigint"


def deal(items: DataFrame, group: list[str], unit: str, weight: str, rows: int, most: int) -> DataFrame:
    """Add ``parts``, the number of chunks of the row's group, and ``own``, its chunk.

    A chunk has about ``rows`` rows or ``most`` weight, so a task that compares
    a pair of chunks has bounded work, whatever the size of the group.
    """
    sizes = items.groupBy(*group).agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / rows), F.ceil(F.sum(weight) / most), F.lit(1)).cast("int").alias("parts")
    )
    return items.join(sizes, group).withColumn("own", F.pmod(F.xxhash64(unit), F.col("parts")).cast("int"))


def pair_up(dealt: DataFrame) -> DataFrame:
    """List every pair ``a <= b`` of chunks of a group; ``own`` is one of them."""
    return (
        dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("a", F.least("own", "_other"))
        .withColumn("b", F.greatest("own", "_other"))
        .drop("parts", "_other")
    )


def link_summary(ids: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    """Rows of ``LINKS`` for the linked pairs (left, right) of positions in ``ids``.

    ``links`` adds up the sizes of what a row is linked with; ``root`` is the
    smallest id it reaches within these pairs.
    """
    links = np.bincount(left, sizes[right], len(ids)) + np.bincount(right, sizes[left], len(ids))
    root = ids.copy()
    while True:
        lower = root.copy()
        np.minimum.at(lower, left, root[right])
        np.minimum.at(lower, right, root[left])
        if np.array_equal(lower, root):
            break
        root = lower
    seen = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[seen]), pa.array(links[seen].astype(np.int64)), pa.array(root[seen])], ["id", "links", "root"]
    )


def components(edges: DataFrame) -> DataFrame:
    """id, component for every id in ``edges`` (u, v); the smallest id names a component.

    Alternates two rewirings until nothing changes: every row hangs its larger
    neighbours under its smallest one, then its smaller neighbours. Each step
    is a group-by and a join, and the number of steps grows with the logarithm
    of the longest chain.
    """
    spark = edges.sparkSession
    larger, smaller = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    current = settle(edges.filter("u <> v").select(larger, smaller).distinct(), "edges")
    state = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(current)
        current = following
        new = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20, 0)"))).first()
        if new == state:
            break
        state = new
    roots = current.select(F.col("v").alias("id")).distinct()
    found = current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("id")))
    result = spark.createDataFrame([], found.schema) if state[0] == 0 else found
    return result
