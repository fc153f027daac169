"""Session settings and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even when that costs one more exchange afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# Largest part of a file and of an exchange, compressed, that one task reads. Lines unfold to some
# twenty times that in a task's hash tables and sorts.
FILE_BYTES, EXCHANGE_BYTES = 32 * 2**20, 16 * 2**20
# partitions of an exchange before small ones are put together: one per so many bytes of the input
INPUT_BYTES = 8 * 2**20
_INITIAL, _SIZED = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.tillstar.initialPartitions"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every job here relies on."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def size_tasks(spark: SparkSession, input_bytes: int) -> None:
    """Let the number of tasks grow with the input, and not what a task holds.

    Smaller settings of the session stay as they are.
    """
    in_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in (("spark.sql.files.maxPartitionBytes", FILE_BYTES), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", EXCHANGE_BYTES)):
        if in_bytes(spark.conf.get(key)) > most:
            spark.conf.set(key, f"{most}b")
    wanted = input_bytes // INPUT_BYTES
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(_INITIAL, str(wanted))
        spark.conf.set(_SIZED, "true")
    elif spark.conf.get(_SIZED, None):  # set for larger tables
        spark.conf.unset(_INITIAL)
        spark.conf.unset(_SIZED)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, for intermediate tables.

    ``spark.checkpoint.dir`` of the session; where that is unset, a folder
    below the session's warehouse directory, which tables share anyway. On a
    cluster that must not be a folder of one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        if configured.startswith(("file:", "/")) and not _one_machine(spark):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share; {configured} is a local one")
    return configured.rstrip("/")


def _one_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def new_folder(spark: SparkSession, label: str) -> str:
    """Path of a folder below ``shared_dir`` that nothing else uses."""
    return f"{shared_dir(spark)}/tillstar/{label}-{uuid.uuid4().hex}"


# folders to be deleted when the work that is under way here is over
_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)


@contextmanager
def own_folders(spark: SparkSession) -> Iterator[None]:
    """Delete what ``settle`` writes inside once the work inside is over.

    Work of other threads is not touched; threads started inside take part if
    they run in a copy of this one's context.
    """
    folders: list[str] = []
    token = _owned.set(folders)
    try:
        yield
    finally:
        _owned.reset(token)
        for path in folders:
            remove_folder(spark, path)


_FREEING, _free_lock = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", threading.Lock()
_freeing: list[str] = []  # one entry per write under way: the setting found by the first


@contextmanager
def freed_exchanges(spark: SparkSession) -> Iterator[None]:
    """Delete what the exchanges of a write inside left on disk once that write is over.

    Else Spark keeps it until the driver collects its garbage, and the
    exchanges of all tables written one after the other lie on disk together.
    Writes may run side by side.
    """
    with _free_lock:
        _freeing.append(_freeing[0] if _freeing else spark.conf.get(_FREEING))
        spark.conf.set(_FREEING, "true")
    try:
        yield
    finally:
        with _free_lock:
            found = _freeing.pop()
            if not _freeing:
                spark.conf.set(_FREEING, found)


def settle(df: DataFrame, label: str, row_group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage for frames used several times. The files survive lost
    executors, and their size on disk tells Spark whether a later join may
    broadcast them. ``discard`` or ``own_folders`` removes them, at the latest
    the end of the application. Rows that unfold to a multiple of their size on
    disk want small row groups, so that tasks can share a file.
    """
    path = new_folder(df.sparkSession, label)
    if (folders := _owned.get()) is not None:
        folders.append(path)
    options = {"parquet.block.size": row_group_bytes} if row_group_bytes else {}
    with freed_exchanges(df.sparkSession):
        df.write.options(**options).parquet(path)
    delete_at_end(df.sparkSession, path)
    settled = df.sparkSession.read.schema(df.schema).parquet(path)
    settled.settled_path = path
    return settled


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have a folder of this library deleted when the application's driver ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote; a missing one is no error."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    try:
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Py4JError:  # an interpreter that is going down
        pass


def discard(*settled: DataFrame) -> None:
    """Delete the files of frames made by ``settle`` once nothing reads them."""
    for df in settled:
        path = getattr(df, "settled_path", None)
        if path:
            remove_folder(df.sparkSession, path)
