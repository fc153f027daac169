"""Vectors on disk: each is filed once, in blocks that tasks read pair by pair."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillstar.llm import pq_dedup
from tillstar.llm.common import prepare
from tillstar.session import discard, settle

VECTOR = "vec_id bigint, embedding array<float>, label int"


def rows_of_two_labels(n=240, dims=16):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(n // 3, dims))
    vectors = np.concatenate([base, base, base + rng.normal(size=base.shape) * 0.04]).astype(np.float32)
    return [(i, [float(x) for x in v], i % 2) for i, v in enumerate(vectors)]


def links_by_cosine(rows):
    vectors = np.array([r[1] for r in rows])
    units = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    near = (units @ units.T >= pq_dedup.THRESHOLD) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None, :])
    return (near.sum(axis=1) - 1).tolist()


def test_a_vector_is_filed_once_whatever_it_visits(spark):
    prepare(spark)
    units = np.array([r[1] for r in rows_of_two_labels()], dtype=np.float64)
    units /= np.sqrt((units * units).sum(axis=1))[:, None]
    quantiser = pq_dedup.Quantiser(units, 20)
    visited, _ = quantiser.probes(units, pq_dedup.nearest_of(units, quantiser.centroids))
    assert len(visited)
    rows = [(int(i % 2), i, 1, bytearray(v.tobytes())) for i, v in enumerate(units)]
    classes = spark.createDataFrame(rows, "label int, id bigint, size bigint, vector binary")
    placed = pq_dedup.file_vectors(classes, {units.shape[1]: quantiser})
    assert sorted(r.id for r in placed.select("id").collect()) == list(range(len(units)))


@pytest.mark.parametrize("component", ["float", "double"])
def test_links_across_blocks_of_any_size(spark, monkeypatch, component):
    rows = rows_of_two_labels()
    expected = links_by_cosine(rows)
    vectors = spark.createDataFrame(rows, VECTOR).withColumn("embedding", F.col("embedding").cast(f"array<{component}>")).repartition(4)
    for chunk_rows in (37, 4096) if component == "float" else (37,):
        monkeypatch.setattr(pq_dedup, "CHUNK_ROWS", chunk_rows)
        found = sorted((r.vec_id, r.n_links) for r in pq_dedup.similar_vectors(vectors).collect())
        assert found == list(enumerate(expected))


def test_vectors_that_share_an_id_span_blocks_in_order(spark, monkeypatch):
    monkeypatch.setattr(pq_dedup, "CHUNK_ROWS", 5)
    rows = [(7, v, label) for _, v, label in rows_of_two_labels(60)]
    found = pq_dedup.similar_vectors(spark.createDataFrame(rows, VECTOR)).collect()
    # all links of all vectors of this id, a class of equal vectors counted once
    counted = dict(zip([(tuple(r[1]), r[2]) for r in rows], links_by_cosine(rows), strict=True))
    copies = {key: sum((tuple(r[1]), r[2]) == key for r in rows) for key in counted}
    total = sum(n - copies[key] + 1 for key, n in counted.items())
    assert {r.n_links for r in found} == {total + max(copies.values()) - 1} and len(found) == len(rows)


def test_no_exchange_outlives_its_write(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def exchanged():
        return {f for f in files.getAllFiles().mkString("\n").split("\n") if f.endswith(".data") and "shuffle_" in f}

    before, setting = exchanged(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    grouped = spark.range(100_000).groupBy((F.col("id") % 5000).alias("k")).agg(F.sum("id").alias("n"))
    kept = settle(grouped, "grouped")
    until = time.time() + 20
    while (left := exchanged() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    assert kept.agg(F.sum("n")).first()[0] == grouped.agg(F.sum("n")).first()[0] == sum(range(100_000))
    discard(kept)
