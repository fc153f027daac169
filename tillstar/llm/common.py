"""What several operators of this subpackage share."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

import tillstar
from tillstar.operators.ordered import with_running_totals
from tillstar.session import delete_at_end, discard, new_folder, settle, tune

#: Most key ranges a sharded writer makes; bounds what is sent to every task.
MAX_RANGES = 65_536
#: Rows that go to a Python worker at once; texts are long.
BATCH_ROWS = 2000
#: White space of the word rule of this subpackage, as a regular expression class.
ASCII_SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{ASCII_SPACE}]+"


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings of this library and send its code to the executors.

    Functions that run in tasks are found there by the name of their module.
    The archive goes through the shared folder, once per application.
    """
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        package = Path(tillstar.__file__).parent
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            for file in sorted(package.rglob("*.py")):
                archive.write(file, file.relative_to(package.parent))
        folder = new_folder(spark, "code")
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/tillstar.zip", compression=None) as stream:
            stream.write(buffer.getvalue())
        delete_at_end(spark, folder)
        context.addPyFile(f"{folder}/tillstar.zip")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one, so that added columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a folder or file in the shared store."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def key_bounds(df: DataFrame, key: str, weight: str, per_range: int) -> np.ndarray:
    """Smallest key of each range of about ``per_range`` weight, in key order.

    A function of the data alone: neither the number of partitions nor a
    sample decides it. Null keys sort first. At most ``MAX_RANGES`` bounds are
    made, whatever the input; beyond that the ranges get heavier.
    """
    narrow = settle(df.select(key, weight), "weights")
    total = narrow.agg(F.sum(weight)).first()[0] or 0
    per_range = max(per_range, -(-total // MAX_RANGES), 1)
    running = with_running_totals(narrow, [F.asc_nulls_first(key)], {"_upto": weight})
    first = (
        running.groupBy(F.floor((F.col("_upto") - F.col(weight)) / F.lit(per_range)).alias("_range"))
        .agg(F.min(key).alias("_first"))
        .select("_first")
    )
    found = sorted({r[0] for r in first.collect() if r[0] is not None})
    discard(narrow)
    return np.array(found, dtype=np.int64)


def range_of(keys: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """Number of the key range of each key; null keys belong to range 0."""
    if not len(bounds):
        return np.zeros(len(keys), dtype=np.int32)
    filled = keys.fill_null(int(bounds[0])).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.maximum(np.searchsorted(bounds, filled, side="right") - 1, 0).astype(np.int32)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def by_group(rows: Iterable[tuple], n_keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Groups of consecutive rows with equal first ``n_keys`` values, as streams."""
    for key, group in itertools.groupby(rows, key=lambda r: r[:n_keys]):
        yield key, (r[n_keys:] for r in group)


def map_sorted_groups(
    df: DataFrame,
    keys: Sequence[str],
    within: Sequence[str],
    function: Callable[[Iterator[tuple[tuple, Iterator[tuple]]]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """Run ``function`` over the groups of ``keys``, each sorted by ``within``.

    A group is streamed, never held as a whole by this helper. ``df``'s columns
    must start with ``keys``.
    """
    n_keys = len(keys)

    def run(batches):
        yield from function(by_group(rows_of(batches), n_keys))

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *within)
    return dealt.mapInArrow(run, schema)


def slices_by_bytes(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column of about ``most`` bytes each."""
    n = len(column)
    if not n:
        return
    lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(lengths) - lengths) // most
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    yield from itertools.pairwise([*starts.tolist(), n])
    # what the slices took is not kept back from the process beside this one
    pa.default_memory_pool().release_unused()


def range_column(column: str, bounds: np.ndarray):
    """Column expression: the key range of ``column``; only the key goes to Python."""
    @pandas_udf("int")
    def number(keys: pd.Series) -> pd.Series:
        return pd.Series(range_of(pa.array(keys, pa.int64(), from_pandas=True), bounds))

    return number(F.col(column))
