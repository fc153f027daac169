"""Shards that all match the mixture of sources: proportional stratified interleaving.

Rows are shuffled by a seed within each source and get a fractional rank
``(rank + 0.5) / rows of the source``. In the order of these ranks every
stretch holds each source in proportion, so equal cuts of that order are
shards with the mixture of the whole. Only keys, sizes and checksums move;
texts never do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstar.llm.running import non_null, piece_count, piece_of_key, seeded_key, with_offsets
from tillstar.session import settle

SEED = 20_240_607
SHARDS = 40
#: Bytes a row takes besides its text.
ROW_BYTES = 16


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, text_crc32, shard, slot.

    Shards differ by at most one row (and so do the counts of any one source
    by two). ``slot`` numbers a shard's rows from 0 without gaps, in the order
    of their fractional ranks.

    Null or empty texts have 0 bytes and the checksum 0; null sources form a
    source of their own; rows with a null or repeated doc_id are ordinary rows,
    and rows equal in id, size, checksum and source are interchangeable. An
    empty table gives no rows. Further columns are ignored.
    """
    rows = docs.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(ROW_BYTES)).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
    )
    rows = settle(rows.withColumn("_key", seeded_key(seed, "doc_id")), "shard-rows")
    n = rows.count()
    pieces = piece_count(n)
    rows = rows.withColumn("_source", non_null("source")).withColumn("_piece", piece_of_key(F.col("_key"), pieces))
    tie = ["_key", "doc_id", "size", "text_crc32"]
    ranked = with_offsets(rows, "_source", "_piece", tie, F.lit(1), "_rank", "_rows")
    fraction = (F.col("_rank") + F.lit(0.5)) / F.col("_rows")
    spread = ranked.drop("_piece").withColumn("_fraction", fraction).withColumn("_all", F.lit(0))
    spread = spread.withColumn("_piece", F.floor(F.col("_fraction") * F.lit(pieces)))
    placed = with_offsets(spread, "_all", "_piece", ["_fraction", *tie, "_source"], F.lit(1), "_at", "_n")
    start = F.expr(f"(shard * _n + {shards - 1}) div {shards}")
    return (
        placed.withColumn("shard", F.expr(f"_at * {shards} div _n").cast("int"))
        .withColumn("slot", (F.col("_at") - start).cast("bigint"))
        .select("doc_id", "source", "size", "text_crc32", "shard", "slot")
    )


def shard_digest(docs: DataFrame) -> DataFrame:
    """``assign_shards`` in the form of the sharding contract; law ``rows``."""
    return assign_shards(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )
