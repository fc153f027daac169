"""Key checks and row-count reconciliation as report frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphan_report(rows: DataFrame, references: Mapping[str, tuple[str, DataFrame, str]]) -> DataFrame:
    """Rows per reference whose key the dimension lacks.

    ``references``: name -> (column of ``rows``, dimension, its key). The rows
    are read once: each gives one (reference, key) pair per check, counted with
    a combine on the map side, so only distinct keys meet the known ones.
    """
    pairs = [F.struct(F.lit(name).alias("reference"), F.col(c).cast("string").alias("_key")) for name, (c, _, _) in references.items()]
    counted = rows.select(F.inline(F.array(*pairs))).filter(F.col("_key").isNotNull()).groupBy("reference", "_key").count()
    known = reduce(
        DataFrame.unionByName,
        [
            dim.select(F.lit(name).alias("reference"), F.col(key).cast("string").alias("_key")).distinct()
            for name, (_, dim, key) in references.items()
        ],
    ).withColumn("_known", F.lit(True))
    missing = F.col("_known").isNull()
    checked = counted.join(known, ["reference", "_key"], "left").groupBy("reference").agg(
        F.sum("count").alias("checked_rows"),
        F.coalesce(F.sum(F.when(missing, F.col("count"))), F.lit(0)).alias("orphan_rows"),
        F.count(F.when(missing, 1)).alias("orphan_keys"),
    )
    # a check without rows is listed too
    names = rows.sparkSession.createDataFrame([(name,) for name in references], "reference string")
    return names.join(checked, "reference", "left").fillna(0, ["checked_rows", "orphan_rows", "orphan_keys"])


def duplicate_report(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Key values that occur more than once per table, and the rows they hold."""
    reports = []
    for name, (df, key) in tables.items():
        repeated = df.groupBy(*key).count().filter(F.col("count") > 1)
        reports.append(
            repeated.agg(
                F.lit(name).alias("table_name"),
                F.count(F.lit(1)).alias("duplicate_keys"),
                F.coalesce(F.sum("count"), F.lit(0)).alias("duplicate_rows"),
            )
        )
    return reduce(DataFrame.unionByName, reports)


def reconcile(fact: DataFrame, clean: DataFrame, source_count: int) -> DataFrame:
    """Compare row counts of fact and clean table with the rows that were read;
    one row with the verdict."""
    counts = (
        fact.select(F.lit("f").alias("t"))
        .unionAll(clean.select(F.lit("c").alias("t")))
        .agg(
            F.count(F.when(F.col("t") == "f", 1)).alias("fact_rows"),
            F.count(F.when(F.col("t") == "c", 1)).alias("clean_rows"),
        )
    )
    counts = counts.withColumn("source_rows", F.lit(source_count).cast("bigint"))

    # fixed values: the labels and the words of the message
    def text(label: str, column: str):
        return F.concat(F.lit(f"{label}="), F.col(column).cast("string"))

    against = F.concat(F.lit(" vs "), text("source", "source_rows"))
    fact_off = F.col("fact_rows") != F.col("source_rows")
    clean_off = F.col("clean_rows") != F.col("source_rows")
    gaps = F.concat_ws(
        "; ",
        F.when(fact_off, F.concat(text("f_sales", "fact_rows"), against)),
        F.when(clean_off, F.concat(text("raw", "clean_rows"), against)),
    )
    fine = F.concat(
        F.lit("OK: "),
        F.concat_ws(", ", text("f_sales", "fact_rows"), text("raw", "clean_rows"), text("source", "source_rows")),
    )
    off = fact_off | clean_off
    return counts.select(
        "fact_rows",
        "clean_rows",
        "source_rows",
        (F.col("source_rows") - F.col("clean_rows")).alias("dropped_rows"),
        F.when(off, "WARN").otherwise("OK").alias("status"),
        F.when(off, F.concat(F.lit("DISCREPANCIA: "), gaps)).otherwise(fine).alias("message"),
    )
