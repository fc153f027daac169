"""Files written by tasks: temporary names, a manifest, and one commit.

A task attempt writes each file under a name of its own and reports it as a
manifest row. Rows of attempts that failed or lost a race never reach the
manifest, so after the stage it names exactly one complete copy of each file.
The commit renames those copies, which may be repeated, and stores the
manifest next to them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstar.llm.common import rows_of, store
from tillstar.session import discard, remove_folder, settle

#: Most tasks that read files back.
MOST_TASKS = 20_000

MANIFEST = "name string, temporary string, bytes bigint, records bigint, sha256 string"
_MANIFEST_ARROW = pa.schema(
    [("name", pa.string()), ("temporary", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())]
)


class ShardFile:
    """One file of a task attempt; counts and digests what is written."""

    def __init__(self, folder: str, name: str):
        self.name, self.temporary = name, f"_temporary/{name}.{uuid.uuid4().hex}"
        fs, root = store(folder)
        path = f"{root}/{self.temporary}"
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream = fs.open_output_stream(path, compression=None)
        self.bytes, self.records, self.digest = 0, 0, hashlib.sha256()

    def write(self, data: bytes, records: int = 0) -> None:
        self.stream.write(data)
        self.digest.update(data)
        self.bytes += len(data)
        self.records += records

    def close(self) -> tuple:
        self.stream.close()
        return self.name, self.temporary, self.bytes, self.records, self.digest.hexdigest()


def manifest_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_MANIFEST_ARROW.names, r, strict=True)) for r in rows], _MANIFEST_ARROW)


def commit(written: DataFrame, folder: str) -> DataFrame:
    """Run the writing frame (rows of ``MANIFEST``) and publish its files.

    Returns the stored manifest with full paths. A rename that a lost executor
    had already done is recognised by the target's size.
    """
    spark = written.sparkSession
    pending = settle(written, "manifest")

    def publish(batches):
        fs, root = store(folder)
        for batch in batches:
            for name, temporary, size, _, _ in rows_of([batch]):
                source, target = f"{root}/{temporary}", f"{root}/{name}"
                if fs.get_file_info(source).type != pafs.FileType.NotFound:
                    fs.move(source, target)
                if fs.get_file_info(target).size != size:
                    raise OSError(f"{target} is incomplete")
            yield batch

    published = pending.repartition("name").sortWithinPartitions("name").mapInArrow(publish, MANIFEST)
    published.withColumn("path", F.concat(F.lit(f"{folder}/"), "name")).write.parquet(f"{folder}/_manifest")
    discard(pending)
    remove_folder(spark, f"{folder}/_temporary")
    return spark.read.parquet(f"{folder}/_manifest")


def read_files(manifest: DataFrame, read: Callable[[str, pafs.FileSystem, str], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Rows of ``read(path, file system, inner path)`` over the files of a manifest.

    A path is a short row that stands for much work, so the number of tasks is
    given: left to the size of the rows, all files would be read by one.
    """

    def run(batches):
        for (path,) in rows_of(batches):
            fs, inner = store(path)
            yield from read(path, fs, inner)

    tasks = min(max(manifest.count(), 1), MOST_TASKS)
    return manifest.select("path").repartition(tasks, "path").mapInArrow(run, schema)
