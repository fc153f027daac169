"""Versioned dimensions (type 2 history), as whole snapshots or bucket by bucket.

A dimension stored in hash buckets of its business key is compared with a batch
by one fingerprint per bucket; members are only compared in buckets that differ,
and only buckets with a change are written again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstar.operators.ordered import with_dense_key
from tillstar.session import settle

NEW, CHANGED, SAME, MISSING = "new", "changed", "unchanged", "missing"
#: Buckets of a stored dimension; a fixed number, as the files lie in them.
BUCKETS = 64


def current(dim: DataFrame) -> DataFrame:
    return dim.filter(F.col("current_flag") == "Y")


def detect_changes(dim: DataFrame, incoming: DataFrame, key: str, tracked: Sequence[str]) -> DataFrame:
    """One row per business key: its status and the incoming tracked values.

    Comparison is null-safe, so a null attribute is not re-versioned each run.
    """
    old = current(dim).select(F.col(key), *[F.col(c).alias(f"_old_{c}") for c in tracked], F.lit(True).alias("_was"))
    new = incoming.select(key, *tracked, F.lit(True).alias("_is"))
    joined = new.join(old, key, "full_outer")
    differs = F.lit(False)
    for c in tracked:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    status = (
        F.when(F.col("_was").isNull(), NEW)
        .when(F.col("_is").isNull(), MISSING)
        .when(differs, CHANGED)
        .otherwise(SAME)
    )
    return joined.select(key, status.alias("status"), *tracked)


def keys_to_expire(changes: DataFrame, key: str, expire_missing: bool = False) -> DataFrame:
    """Keys whose current version ends: the changed ones, and on request the vanished ones."""
    ended = [CHANGED, MISSING] if expire_missing else [CHANGED]
    return changes.filter(F.col("status").isin(ended)).select(key)


def missing_keys(dim: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Current business keys the incoming batch no longer has."""
    return current(dim).select(key).join(incoming.select(key), key, "left_anti")


def next_key(dim: DataFrame, surrogate: str) -> int:
    """One more than the largest surrogate key; 1 for an empty dimension."""
    return dim.agg((F.coalesce(F.max(surrogate), F.lit(0)) + 1).alias("n")).first()["n"]


def apply_versions(
    dim: DataFrame,
    incoming: DataFrame,
    surrogate: str,
    key: str,
    tracked: Sequence[str],
    run_date: dt.date,
    expire_missing: bool = False,
    start: int | None = None,
) -> DataFrame:
    """The full next snapshot of ``dim``: untouched, expired and inserted versions.

    Plain Parquet has no update in place, so the caller writes this frame as a
    new snapshot. Surrogates of inserted versions follow the largest one, or go
    on from ``start``, in business-key order.
    """
    columns = dim.columns
    changes = settle(detect_changes(dim, incoming, key, tracked), "changes")
    ending = keys_to_expire(changes, key, expire_missing).withColumn("_ends", F.lit(True))
    live = F.col("current_flag") == "Y"
    ends = live & F.col("_ends").isNotNull()
    carried = (
        dim.join(ending, key, "left")
        .withColumn("expiration_date", F.when(ends, F.lit(run_date)).otherwise(F.col("expiration_date")))
        .withColumn("current_flag", F.when(ends, F.lit("N")).otherwise(F.col("current_flag")))
        .select(*columns)
    )
    arriving = changes.filter(F.col("status").isin(NEW, CHANGED)).select(key, *tracked)
    inserted = (
        with_dense_key(arriving, surrogate, [key], start=next_key(dim, surrogate) if start is None else start)
        .withColumn("effective_date", F.lit(run_date))
        .withColumn("expiration_date", F.lit(None).cast("date"))
        .withColumn("current_flag", F.lit("Y"))
        .select(*columns)
    )
    return carried.unionByName(inserted)


def first_versions(
    incoming: DataFrame, surrogate: str, key: str, tracked: Sequence[str], run_date: dt.date
) -> DataFrame:
    """Initial load: every business key once, current from ``run_date`` on."""
    return (
        with_dense_key(incoming.select(key, *tracked), surrogate, [key])
        .withColumn("effective_date", F.lit(run_date))
        .withColumn("expiration_date", F.lit(None).cast("date"))
        .withColumn("current_flag", F.lit("Y"))
    )


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    """Bucket of a business key, by its MD5; that of a null key is 0."""
    head = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.coalesce(F.pmod(head, F.lit(buckets)), F.lit(0)).cast("int")


def fingerprints(rows: DataFrame, key: str, tracked: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """bucket, members and two sums of hashes over key and tracked values."""
    values = [x for c in (key, *tracked) for x in (F.col(c).isNull(), F.col(c).cast("string"))]
    hashes = {"mark": F.xxhash64(*values), "second_mark": F.xxhash64(F.lit("second"), *values)}
    return rows.groupBy(bucket_of(key, buckets).alias("bucket")).agg(
        F.count(F.lit(1)).alias("members"), *[F.sum(h.cast("decimal(20,0)")).alias(name) for name, h in hashes.items()]
    )


def differing_buckets(dim: DataFrame, incoming: DataFrame, key: str, tracked: Sequence[str], buckets: int = BUCKETS) -> list[int]:
    """Buckets in which the current versions are not exactly the incoming members; one row per bucket."""
    old, new = (fingerprints(rows, key, tracked, buckets) for rows in (current(dim), incoming))
    same = old.intersect(new).select("bucket")
    either = old.select("bucket").union(new.select("bucket")).distinct()
    return sorted(r.bucket for r in either.join(same, "bucket", "left_anti").collect())


def apply_in_buckets(
    dim: DataFrame,
    incoming: DataFrame,
    surrogate: str,
    key: str,
    tracked: Sequence[str],
    run_date: dt.date,
    expire_missing: bool = False,
    buckets: int = BUCKETS,
) -> tuple[DataFrame, list[int]]:
    """The next rows of the buckets with a change, and which these are.

    All other buckets stay as they are. The rows equal those of
    ``apply_versions``, surrogates included. ``dim`` has a column ``bucket``.
    """
    columns = [c for c in dim.columns if c != "bucket"]
    differing = differing_buckets(dim, incoming, key, tracked, buckets)

    def within(rows: DataFrame, wanted: Sequence[int]) -> DataFrame:
        return rows.filter(F.col("bucket").isin(list(wanted))).drop("bucket")

    arriving = incoming.withColumn("bucket", bucket_of(key, buckets))
    changes = detect_changes(within(dim, differing), within(arriving, differing), key, tracked)
    acting = [NEW, CHANGED, MISSING] if expire_missing else [NEW, CHANGED]
    touched = changes.filter(F.col("status").isin(acting)).select(bucket_of(key, buckets).alias("bucket")).distinct()
    wanted = sorted(r.bucket for r in touched.collect())
    following = apply_versions(
        within(dim, wanted).select(*columns), within(arriving, wanted), surrogate, key, tracked, run_date, expire_missing,
        start=next_key(dim, surrogate),
    )
    return following.withColumn("bucket", bucket_of(key, buckets)), wanted


def new_members(dim: DataFrame, incoming: DataFrame, surrogate: str, key: Sequence[str]) -> DataFrame:
    """Members of ``incoming`` that ``dim`` lacks, numbered on from its largest key in key order."""
    known = dim.select(*[F.col(c).alias(f"_{c}") for c in key])
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    fresh = incoming.drop(surrogate).join(known, same, "left_anti")
    return with_dense_key(fresh, surrogate, list(key), start=next_key(dim, surrogate))
