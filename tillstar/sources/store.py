"""Catalog tables: creation, replacement, append, partial overwrite, audit rows, run ledger."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from decimal import Decimal

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstar.schemas import ETL_LOG, PARTITIONS, STAR


def ensure_database(spark: SparkSession, database: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the time of the work inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _partitions_by_folder(spark: SparkSession):
    """Tables made inside find partitions in their folder: the catalog would
    keep the places of partitions when a table is renamed."""
    return _setting(spark, "spark.sql.hive.manageFilesourcePartitions", "false")


def ensure_tables(spark: SparkSession, database: str) -> None:
    """Create the star's tables with their declared types where absent."""
    ensure_database(spark, database)
    for name, schema in STAR.items():
        if not spark.catalog.tableExists(f"{database}.{name}"):
            with _partitions_by_folder(spark):
                writer = spark.createDataFrame([], schema).write.format("parquet")
                writer.partitionBy(*PARTITIONS.get(name, [])).saveAsTable(f"{database}.{name}")


def replace_table(
    df: DataFrame, table: str, partition_by: Sequence[str] = (), bucket_by: tuple[int, str] | None = None
) -> DataFrame:
    """Overwrite ``table`` with ``df``, which may itself read ``table``.

    The new rows are complete under another name before the old table steps
    aside, and that one goes only when the new one is in place: a failure at
    any point leaves one of them whole. ``bucket_by`` (number, column) stores
    rows in buckets, so that tables of as many buckets join on the column
    without moving rows.
    """
    spark = df.sparkSession
    staged, former = f"{table}__next", f"{table}__former"
    spark.sql(f"DROP TABLE IF EXISTS {staged}")
    with _partitions_by_folder(spark):
        writer = df.write.format("parquet")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        if bucket_by:
            writer = writer.bucketBy(*bucket_by).sortBy(bucket_by[1])
        writer.saveAsTable(staged)
    if spark.catalog.tableExists(table):
        spark.sql(f"DROP TABLE IF EXISTS {former}")
        spark.sql(f"ALTER TABLE {table} RENAME TO {former}")
    spark.sql(f"ALTER TABLE {staged} RENAME TO {table}")
    spark.sql(f"DROP TABLE IF EXISTS {former}")
    return spark.table(table)


def overwrite_partitions(df: DataFrame, table: str) -> DataFrame:
    """Replace those partitions of ``table`` that ``df`` has rows for.

    All other partitions keep their files. The new files are complete in a
    staging folder before any partition is replaced, so a failing job leaves
    the table whole. ``df`` must not read the table: pass settled rows.
    """
    spark = df.sparkSession
    with _partitions_by_folder(spark), _setting(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
        df.select(*spark.table(table).columns).write.insertInto(table, overwrite=True)
    spark.catalog.refreshTable(table)
    return spark.table(table)


def file_fingerprint(spark: SparkSession, *paths: str) -> str:
    """What tells whether files changed: a digest of their paths, lengths and times.

    The files are listed, not read; the digest is one row of sums.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)")
    row = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), F.sum(mark).alias("mark")).first()
    return f"{row.n}-{row.bytes or 0}-{row.mark or 0}"


def append_table(df: DataFrame, table: str) -> DataFrame:
    df.write.format("parquet").mode("append").saveAsTable(table)
    return df.sparkSession.table(table)


def as_declared(df: DataFrame, table: str) -> DataFrame:
    """Columns of ``df`` in the order and types declared for a star table."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in STAR[table].fields])


def log_step(
    spark: SparkSession, database: str, step: str, rows: int, status: str, message: str, seconds: float
) -> None:
    """Append one audit row; the log holds a handful of rows per load."""
    table = f"{database}.etl_log"
    last = spark.table(table).agg(F.coalesce(F.max("log_id"), F.lit(0))).first()[0]
    row = (last + 1, None, step, int(rows), status, message, Decimal(str(round(seconds, 2))))
    kind = next(f.dataType for f in ETL_LOG.fields if f.name == "run_date")
    logged = spark.createDataFrame([row], ETL_LOG).withColumn("run_date", F.current_timestamp().cast(kind))
    append_table(logged, table)


def health(spark: SparkSession, database: str) -> DataFrame:
    """Fact rows and the latest audit row, as one row."""
    facts = spark.table(f"{database}.f_sales").count()
    latest = spark.table(f"{database}.etl_log").agg(
        F.max_by(F.struct("log_id", "step", "run_date", "status"), F.col("log_id")).alias("last")
    )
    return latest.select(
        F.lit("healthy").alias("status"),
        F.lit(facts).cast("bigint").alias("fact_rows"),
        F.col("last.log_id").alias("last_log_id"),
        F.col("last.step").alias("last_step"),
        F.col("last.run_date").alias("last_run_date"),
        F.col("last.status").alias("last_status"),
    )


class CachedView:
    """A view kept in memory (spilling to disk) until the next load, or until its ``stamp`` changes."""

    def __init__(self, build: Callable[[], DataFrame], stamp: Callable[[], object] = lambda: None):
        self._build, self._stamp = build, stamp
        self._frame: DataFrame | None = None
        self._stamped: object = None

    def get(self) -> DataFrame:
        stamp = self._stamp()
        if self._frame is None or stamp != self._stamped:
            return self._renew(stamp)
        return self._frame

    def refresh(self) -> DataFrame:
        return self._renew(self._stamp())

    def _renew(self, stamp: object) -> DataFrame:
        if self._frame is not None:
            self._frame.unpersist()
        self._stamped = stamp
        self._frame = self._build().persist(StorageLevel.MEMORY_AND_DISK)
        return self._frame


class Ledger:
    """Which steps of which run are complete, as rows of ``load_ledger``.

    A run is identified by what goes into it. A run that did not come to its
    end is taken up again: its complete steps are not done twice.
    """

    def __init__(self, spark: SparkSession, database: str, inputs: str, last_step: str):
        self.spark, self.table, self.inputs = spark, f"{database}.load_ledger", inputs
        rows = spark.table(self.table).filter(F.col("inputs") == inputs).orderBy("finished").collect()
        over = {r.run for r in rows if r.step == last_step}
        waiting = [r.run for r in rows if r.run not in over]
        self.run = waiting[-1] if waiting else uuid.uuid4().hex
        self.complete = {r.step: r.rows for r in rows if r.run == self.run}

    def done(self, step: str, rows: int) -> None:
        self.complete[step] = rows
        row = self.spark.createDataFrame([(self.run, self.inputs, step, int(rows))], "run string, inputs string, step string, rows bigint")
        append_table(row.withColumn("finished", F.current_timestamp()), self.table)
