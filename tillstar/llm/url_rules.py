"""URL rules by a sort-merge range join over reversed-host keys.

A rule (host, path prefix) fits a url if the url's host is the rule's host or
below it and the url's path starts with the rule's. Written as
``reversed host # path``, a rule is an interval of keys: all that start with
it. A url is a point in the interval of each suffix of its host. Points and
interval starts are sorted together; a sweep carries the stack of rules that
were open at the last start, and the open ones that a point lies in are the
prefixes of its key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillstar.session import settle

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Verdict on a url that no rule fits.
OTHERWISE = "allow"
#: Ends the host part of a key; no host and no path holds it.
END_OF_HOST = "#"


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and for what has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _sweep(points: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``_open``: the stack of the last rule at or before each point's key.

    Rules and points are sorted together over range partitions; a partition
    takes over the stack of the last rule before it, of which there is one per
    partition.
    """
    starts = rules.select("key", F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("_point"), "stack")
    both = starts.unionByName(
        points.select("key", F.lit(1).alias("_kind"), F.col("_point"), F.lit(None).cast(rules.schema["stack"].dataType).alias("stack"))
    )
    # written out, so that slice numbers and the stacks taken over come from one run
    order = ["key", "_kind", "_point"]
    sliced = settle(
        both.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()).sortWithinPartitions(*order), "url-sweep"
    )
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        sliced.groupBy("_slice")
        .agg(F.max_by("stack", F.when(F.col("_kind") == 0, F.col("key"))).alias("_last"))
        .select("_slice", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    )
    upto = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        sliced.withColumn("_stack", F.last("stack", ignorenulls=True).over(upto))
        .filter("_kind = 1")
        .join(carried, "_slice")
        .select("_point", "key", F.coalesce("_stack", "_carried").alias("_open"))
    )


def with_stacks(rules: DataFrame) -> DataFrame:
    """key, stack: the rule and all rules whose interval encloses it.

    A rule's key may be enclosed by those that are prefixes of it; they are
    found by an equality join with its prefixes, so no pair of unrelated rules
    meets.
    """
    end = F.lit(END_OF_HOST)
    keyed = (
        rules.filter("host is not null and host <> '' and verdict is not null")
        .withColumn("path", F.coalesce("path", F.lit("")))
        .withColumn("host", url_lower("host"))
        .withColumn("rule", F.concat("host", "path"))
        .groupBy("host", "path", "rule")
        .agg(F.min("verdict").alias("verdict"))
        .withColumn("_head", F.concat(F.array_join(reversed_labels(F.col("host")), "."), end))
        .withColumn("key", F.concat("_head", "path"))
        .select("key", "_head", "path", F.struct(F.length("rule").alias("length"), "rule", "verdict", "key").alias("found"))
    )
    prefixes = keyed.select(
        "key",
        F.explode(F.expr("transform(sequence(0, length(path)), n -> concat(_head, left(path, n)))")).alias("_prefix"),
    )
    enclosing = keyed.select(F.col("key").alias("_prefix"), "found")
    return (
        prefixes.join(enclosing, "_prefix")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list("found"), asc=False).alias("stack"))
    )


def url_lower(name: str) -> Column:
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def judge_urls(pages: DataFrame, rules: DataFrame, otherwise: str = OTHERWISE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    Of the rules that fit, the longest (characters of host and path) wins; of
    two as long the greater rule text. A rule given twice with different
    verdicts blocks only if every verdict is block, as the smaller word wins.
    Without a fitting rule ``rule`` is null and the verdict ``otherwise``.

    Null urls and those without ``://`` have empty host and path and fit no
    rule. Repeated pages and urls are judged once and returned as often as they
    come. Rules without a host are ignored; empty tables are fine. Further
    columns are ignored, whatever their names.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    stacks = settle(with_stacks(rules), "url-rules")
    deepest = stacks.agg(F.max(F.size(F.split(F.substring_index("key", END_OF_HOST, 1), r"\.")))).first()[0] or 0
    distinct = settle(
        parts.groupBy("host", "path").agg(F.count(F.lit(1)).alias("_pages")).withColumn("_point", F.monotonically_increasing_id()),
        "url-distinct",
    )
    labels = reversed_labels(F.col("host"))
    points = (
        distinct.filter(F.col("host") != "")
        .withColumn("_labels", labels)
        .withColumn("_level", F.explode(F.sequence(F.lit(1), F.least(F.size("_labels"), F.lit(max(deepest, 1))))))
        .select(
            "_point",
            F.concat(F.array_join(F.slice("_labels", F.lit(1), F.col("_level")), "."), F.lit(END_OF_HOST), "path").alias("key"),
        )
    )
    swept = _sweep(points, stacks)
    inside = F.filter("_open", lambda rule: F.startswith(F.col("key"), rule["key"]))
    best = (
        swept.select("_point", F.array_max(inside).alias("_best"))
        .filter("_best is not null")
        .groupBy("_point")
        .agg(F.max("_best").alias("_best"))
    )
    verdicts = distinct.join(best, "_point", "left").select(
        "host",
        "path",
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(otherwise)).alias("verdict"),
    )
    return parts.join(verdicts, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict")
