"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source's documents are shuffled by a seed and laid end to end; equal
blocks of words cut that stream. The highest quotients ``target / (2k - 1)``
award blocks to sources, which gives whole quotas per shard: the method is
monotone in the number of blocks, so a shard's quota is the difference of two
prefixes of the award order. A source hands out its blocks in seeded cyclic
order, starting over when all have been taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillstar.llm.common import WORD, whole_row
from tillstar.llm.running import non_null, piece_count, piece_of_key, seeded_key, with_offsets
from tillstar.session import settle

SEED = 20_240_611
#: Words of a block, shards of the mix, and the most often a word is repeated.
BLOCK_WORDS, SHARDS, MOST_REPEATS = 128, 16, 3
#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, weight, target per source.

    The targets share the total size by weight; none exceeds ``most`` times its
    source's size, and what is cut off goes to the others by weight until no
    target is above. That is one water level: in ascending order of
    ``cap / weight`` a prefix of the sources sits at its cap and the rest
    shares what remains. One row per source is ordered in one window.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.asc_nulls_last("source"))
    listed = F.array(*[F.lit(w) for w in weights])
    weighted = by_source.withColumn("_i", F.row_number().over(in_order) - 1).withColumn(
        "weight", F.element_at(listed, (F.col("_i") % len(weights) + 1).cast("int"))
    )
    whole = Window.partitionBy()
    by_level = Window.orderBy("_level", "_i")
    upto = by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = (
        weighted.withColumn("_total", F.sum("source_size").over(whole))
        .withColumn("_cap", F.col("source_size") * most)
        .withColumn("_level", F.col("_cap") / F.col("weight"))
        .withColumn("_caps", F.sum("_cap").over(upto))
        .withColumn("_free", F.sum("weight").over(whole) - F.sum("weight").over(upto))
        .withColumn("_next", F.lead("_level").over(by_level))
    )
    # the share per weight if exactly the sources up to this one sit at their caps
    share = F.when(F.col("_free") > 0, (F.col("_total") - F.col("_caps")) / F.col("_free"))
    fits = (share <= F.col("_next")) & (share >= F.col("_level"))
    none_capped = F.col("_total") / F.sum("weight").over(whole)
    water = F.when(none_capped <= F.min("_level").over(whole), none_capped).otherwise(
        F.coalesce(F.min(F.when(fits, share)).over(whole), F.max("_level").over(whole))
    )
    return (
        levels.withColumn("_water", water)
        .withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_water") * F.col("weight")))
        .select("source", "source_size", "weight", "target")
    )


def shard_quotas(
    targets: DataFrame, block: int = BLOCK_WORDS, shards: int = SHARDS, most: int = MOST_REPEATS
) -> DataFrame:
    """source, shard, quota: blocks a shard takes from a source, in whole numbers.

    After ``h`` awards a source holds as many blocks as it has quotients among
    the ``h`` highest. With T the sum of targets and S sources, all quotients
    above the divisor T / (h - S/2) are among them and those below T / (h + S/2)
    are not, so only about two quotients a source need ranking per shard.
    No source gets more blocks than ``most`` passes over it have.
    """
    whole = Window.partitionBy()
    blocks = F.greatest(F.round(F.col("source_size") / F.lit(block)), F.lit(1)).cast("bigint")
    totals = (
        targets.filter("source_size > 0")
        .withColumn("_total", F.sum("target").over(whole))
        .withColumn("_s", F.count(F.lit(1)).over(whole))
        .withColumn("_blocks", blocks)
        .withColumn("_all", F.greatest(F.round(F.col("_total") / F.lit(block)), F.lit(1)).cast("bigint"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .withColumn("_h", F.expr(f"(shard + 1) * _all div {shards}"))
    )
    limit = F.col("_blocks") * most

    def seats(awards: Column) -> Column:
        return F.when(awards > 0, F.least(F.floor(F.col("target") * awards / F.col("_total") + 0.5), limit)).otherwise(
            F.lit(0)
        )

    bounds = totals.withColumn("_sure", seats(F.col("_h") - F.col("_s") / 2)).withColumn(
        "_possible", F.greatest(seats(F.col("_h") + F.col("_s") / 2 + 1), F.col("_sure"))
    )
    per_shard = Window.partitionBy("shard")
    open_seats = bounds.withColumn("_open", F.col("_h") - F.sum("_sure").over(per_shard)).withColumn(
        "_k", F.explode(F.expr("sequence(_sure, _possible)"))
    )
    # the row with _k = _sure keeps sources without an open quotient
    quotient = F.when(F.col("_k") > F.col("_sure"), F.col("target") / (2 * F.col("_k") - 1))
    highest = per_shard.orderBy(F.desc_nulls_last("_quotient"), F.asc_nulls_last("source"))
    upto = (
        open_seats.withColumn("_quotient", quotient)
        .withColumn("_place", F.row_number().over(highest))
        .groupBy("source", "shard")
        .agg(
            (
                F.max("_sure")
                + F.sum(F.when(F.col("_quotient").isNotNull() & (F.col("_place") <= F.col("_open")), 1).otherwise(0))
            ).alias("_seats"),
            F.max("_blocks").alias("blocks"),
        )
    )
    before = Window.partitionBy("source").orderBy("shard")
    return upto.select(
        "source",
        "shard",
        (F.col("_seats") - F.coalesce(F.lag("_seats").over(before), F.lit(0))).alias("quota"),
        "blocks",
    )


def _words_below(position: str) -> str:
    """Words of the first ``position`` blocks; blocks of a source differ by one word at most."""
    product = f"cast({position} as decimal(19, 0)) * cast(source_size as decimal(19, 0))"
    return f"({product} div blocks)"


def mix(docs: DataFrame, seed: int = SEED, block: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, quota
    (blocks of its source in the mix) and taken (words of the document in the
    mix, repeats counted).

    The mix of a source is ``quota`` consecutive blocks of its cyclic stream,
    from a seeded start: each shard takes the next of them up to its quota. No
    document is taken more than three times over, and every source's sum of
    ``taken`` is its target up to about a block.

    Null, empty and blank texts have size 0 and are taken 0 times; null sources
    come last in the order of weights; rows with null or repeated ids are rows
    like others. An empty table gives no rows. Further columns are ignored.
    """
    sizes = settle(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), seeded_key(seed, "doc_id").alias("_key")),
        "mix-sizes",
    )
    targets = source_targets(sizes)
    quotas = (
        shard_quotas(targets, block, shards)
        .groupBy("source")
        .agg(F.sum("quota").alias("quota"), F.max("blocks").alias("blocks"))
    )
    plan = (
        targets.join(quotas.withColumnRenamed("source", "_qs"), F.col("source").eqNullSafe(F.col("_qs")), "left")
        .select(
            non_null("source").alias("_source"),
            "target",
            F.coalesce("quota", F.lit(0)).cast("bigint").alias("quota"),
            F.coalesce("blocks", F.lit(1)).cast("bigint").alias("blocks"),
        )
        .withColumn("_start", F.pmod(F.conv(F.substring(seeded_key(seed + 1, "_source"), 1, 8), 16, 10).cast("bigint"), F.col("blocks")))
    )
    rows = sizes.withColumn("_source", non_null("source")).withColumn(
        "_piece", piece_of_key(F.col("_key"), piece_count(sizes.count()))
    )
    laid = with_offsets(rows, "_source", "_piece", ["_key", "doc_id", "size"], F.col("size"), "_from", "source_size")
    laid = laid.join(plan, "_source").withColumn("_to", F.col("_from") + F.col("size"))
    # the cyclic stream is cut after whole blocks: [start, start + quota)
    first, last = _words_below("_start"), _words_below("(_start + quota) % blocks")
    passes = "((_start + quota) div blocks)"
    covered = (
        f"{passes} * size"
        f" + greatest(0, least(_to, {last}) - _from)"
        f" - greatest(0, least(_to, {first}) - _from)"
    )
    return laid.withColumn("taken", F.expr(covered).cast("bigint")).select(
        "doc_id", "source", "size", "source_size", "target", "quota", "taken"
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, for a pipeline.

    A document whose last pass is cut by the end of its source's blocks counts
    whole for that pass if at least half of it was taken; at most two documents
    a source are cut. Rows of equal id and size share one decision.
    """
    decision = (
        mix(docs)
        .filter("size > 0")
        .select("doc_id", "size", F.expr("cast(floor(taken / size + 0.5) as int)").alias("copies"))
        .groupBy("doc_id", "size")
        .agg(F.max("copies").alias("copies"))
        .filter("copies > 0")
    )
    rows = docs.select(F.col("doc_id").alias("id"), word_count(F.col("text")).alias("words"), whole_row(docs).alias("row"))
    joined = rows.join(decision, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("words") == F.col("size")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
