"""Near-duplicate vectors by product quantisation.

Unit vectors are filed under coarse centroids; what is left of each is coded
in subspaces. A vector visits every list that could hold a neighbour within
the linking distance: a neighbour on the other side of the border between two
centroids is at least as far as that border. In a list, distances to all codes
come from one table per visitor; a code's own error bounds how far the true
distance can lie below, so no neighbour is screened out. The rest is decided
by the exact cosine in double precision.

A vector is filed once, whatever it visits: the vectors of a label lie in
blocks by list in the shared folder, and a task reads the two blocks that it
compares.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tillstar.llm.common import by_group, rows_of, store
from tillstar.llm.links import LINKS, components, link_summary
from tillstar.session import delete_at_end, discard, new_folder, remove_folder, settle

THRESHOLD = 0.98
#: Distance of unit vectors at the threshold, with room for rounding.
REACH = math.sqrt(2 - 2 * THRESHOLD) + 1e-6
#: Vectors the quantisers learn from (the rows of smallest hash), and the most lists.
SAMPLE, MOST_LISTS = 20_000, 2048
#: Subspaces, codes of each, and steps of k-means.
SUBSPACES, CODES, STEPS = 8, 64, 10
SEED = 20_240_621
#: Rows of a block and its bytes in doubles, visitors looked up and pairs reranked at once.
CHUNK_ROWS, CHUNK_BYTES, VISITORS, PAIRS = 4096, 8 << 20, 512, 1 << 16
#: Most tasks that compare blocks.
MOST_TASKS = 20_000

PLACED = "dims int, label int, list int, id bigint, size bigint, vector binary"
#: A block's place in a file of the shared folder; blocks of a label are numbered by list.
BLOCKS = "dims int, label int, first_list int, first_id bigint, path string, start bigint, length int"


def k_means(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of at most ``k`` clusters; fewer if there are fewer points."""
    k = max(1, min(k, len(points)))
    centroids = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(STEPS):
        nearest = nearest_of(points, centroids)
        counts = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        used = counts > 0
        centroids[used] = sums[used] / counts[used, None]
    return centroids


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def nearest_of(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate(
        [squared_distances(points[a : a + 4096], centroids).argmin(axis=1) for a in range(0, len(points), 4096)]
        or [np.zeros(0, int)]
    )


class Quantiser:
    """Coarse centroids and subspace codebooks for vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int):
        rng = np.random.default_rng(SEED)
        self.dims = sample.shape[1]
        self.centroids = k_means(sample, lists, rng)
        self.width = -(-self.dims // SUBSPACES)
        left = self.padded(sample - self.centroids[nearest_of(sample, self.centroids)])
        self.books = [k_means(left[:, s], CODES, rng) for s in range(SUBSPACES)]

    def padded(self, residuals: np.ndarray) -> np.ndarray:
        """Residuals as (rows, subspaces, width), filled up with zeros."""
        full = np.zeros((len(residuals), SUBSPACES * self.width))
        full[:, : self.dims] = residuals
        return full.reshape(len(residuals), SUBSPACES, self.width)

    def encode(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the distance of each residual from what its code stands for."""
        parts = self.padded(residuals)
        codes = np.stack([nearest_of(parts[:, s], self.books[s]) for s in range(SUBSPACES)], axis=1).astype(np.uint8)
        decoded = np.stack([self.books[s][codes[:, s]] for s in range(SUBSPACES)], axis=1)
        return codes, np.sqrt(((parts - decoded) ** 2).sum(axis=(1, 2)))

    def probes(self, units: np.ndarray, home: np.ndarray, lists: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of each list past a row's own number that its neighbours may be in; only ``lists`` if given."""
        lists = np.arange(len(self.centroids)) if lists is None else lists
        own = ((units - self.centroids[home]) ** 2).sum(axis=1)
        apart = np.sqrt(squared_distances(self.centroids, self.centroids[lists]))[home]
        # the border between two centroids is (d_list - d_home) / (2 apart) away
        near = squared_distances(units, self.centroids[lists]) - own[:, None] <= 2 * REACH * apart + 1e-9
        row, at = np.nonzero(near & (lists[None, :] > home[:, None]))
        return row, lists[at]

    def table_distances(self, residuals: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances of each residual to each code, from one table per subspace."""
        parts = self.padded(residuals)
        total = np.zeros((len(residuals), len(codes)))
        for s in range(SUBSPACES):
            total += squared_distances(parts[:, s], self.books[s])[:, codes[:, s]]
        return np.sqrt(total)


def number_type(vectors: DataFrame) -> str:
    """Type in which vectors are kept: single precision where the table's is."""
    kind = vectors.schema["embedding"].dataType
    return "<f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "<f8"


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector (binary, of ``number_type``) of the rows that may link."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int32()), ("vector", pa.binary())])
    kind = number_type(vectors)

    def run(batches):
        for batch in batches:
            vec_ids, labels, lists = batch.columns
            lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            lengths[(vec_ids.is_null().to_numpy(zero_copy_only=False)) | (labels.is_null().to_numpy(zero_copy_only=False))] *= -1
            # a null component is none that a vector may have
            numbers = lists.flatten().fill_null(math.nan).to_numpy(zero_copy_only=False)
            starts = np.cumsum(np.abs(lengths)) - np.abs(lengths)
            for dims in np.unique(lengths[lengths > 0]).tolist():
                at = np.flatnonzero(lengths == dims)
                matrix = numbers[starts[at][:, None] + np.arange(dims)].astype(np.float64)
                with np.errstate(over="ignore", invalid="ignore"):
                    norms = np.einsum("ij,ij->i", matrix, matrix)
                kept = np.isfinite(matrix).all(axis=1) & (norms > 0) & (norms < math.inf)
                at, data = at[kept], (matrix[kept] + 0.0).astype(kind)
                if len(at):
                    columns = [vec_ids.take(pa.array(at)), labels.take(pa.array(at)), pa.array([row.tobytes() for row in data], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    components_of = F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>")
    columns = vectors.select(F.col("vec_id").cast("bigint"), F.col("label").cast("int"), components_of)
    return columns.mapInArrow(run, "vec_id bigint, label int, vector binary")


def matrix_of(vectors: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows in doubles, and the same at unit length."""
    raw = np.frombuffer(b"".join(vectors), dtype=kind).reshape(len(vectors), -1).astype(np.float64)
    return raw, raw / np.sqrt((raw * raw).sum(axis=1))[:, None]


def fit(classes: DataFrame, dims: int, per_label: int, kind: str) -> Quantiser:
    """Learn from the ``SAMPLE`` rows of smallest hash.

    With as many lists as the square root of a label's rows, a vector meets
    about as many lists as a list has members of its label.
    """
    rows = classes.filter(F.octet_length("vector") == np.dtype(kind).itemsize * dims).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    return Quantiser(matrix_of([bytes(r[0]) for r in rows.select("vector").collect()], kind)[1], min(math.isqrt(per_label) + 1, MOST_LISTS))


def file_vectors(classes: DataFrame, quantisers: dict[int, Quantiser], kind: str = "<f8") -> DataFrame:
    """Rows of ``PLACED``: every vector in its list, once."""
    schema = pa.schema(
        [("dims", pa.int32()), ("label", pa.int32()), ("list", pa.int32()), ("id", pa.int64()), ("size", pa.int64()), ("vector", pa.binary())]
    )
    shared = classes.sparkSession.sparkContext.broadcast(quantisers)
    itemsize = np.dtype(kind).itemsize

    def run(batches):
        for batch in batches:
            vectors = batch.column(3)
            lengths = pc.binary_length(vectors).to_numpy(zero_copy_only=False) // itemsize
            for dims in np.unique(lengths).tolist():
                at = pa.array(np.flatnonzero(lengths == dims))
                own = batch.take(at)
                _, units = matrix_of(own.column(3).to_pylist(), kind)
                home = nearest_of(units, shared.value[dims].centroids)
                columns = [pa.array(np.full(len(at), dims), pa.int32()), own.column(0), pa.array(home, pa.int32()), own.column(1), own.column(2), own.column(3)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return classes.select("label", "id", "size", "vector").mapInArrow(run, PLACED)


class Block(NamedTuple):
    """Vectors of one label in the order of their lists."""

    home: np.ndarray
    ids: np.ndarray
    sizes: np.ndarray
    errors: np.ndarray
    codes: np.ndarray
    raw: np.ndarray
    units: np.ndarray


def _packed(quantiser: Quantiser, rows: list[tuple], kind: str) -> bytes:
    """A block's bytes; ``rows`` are (list, id, size, vector)."""
    home, ids, sizes = (np.array([r[i] for r in rows]) for i in range(3))
    _, units = matrix_of([r[3] for r in rows], kind)
    codes, errors = quantiser.encode(units - quantiser.centroids[home])
    return b"".join([home.astype("<i4").tobytes(), ids.astype("<i8").tobytes(), sizes.astype("<i8").tobytes(), errors.astype("<f8").tobytes(), codes.tobytes(), *[r[3] for r in rows]])


def _unpacked(data: bytes, dims: int, kind: str) -> Block:
    fields, at = [], 0
    shapes = [("<i4", ()), ("<i8", ()), ("<i8", ()), ("<f8", ()), ("u1", (SUBSPACES,)), (kind, (dims,))]
    n = len(data) // sum(np.dtype(t).itemsize * math.prod(shape) for t, shape in shapes)
    for t, shape in shapes:
        fields.append(np.frombuffer(data, t, n * math.prod(shape), at).reshape(n, *shape))
        at += fields[-1].nbytes
    home, ids, sizes, errors, codes, vectors = fields
    raw = vectors.astype(np.float64)
    return Block(home.astype(np.int64), ids, sizes, errors, codes, raw, raw / np.sqrt((raw * raw).sum(axis=1))[:, None])


def write_blocks(placed: DataFrame, quantisers: dict[int, Quantiser], kind: str, folder: str) -> DataFrame:
    """Write the vectors in blocks; returns the rows of ``BLOCKS``.

    A task attempt writes one file under a name of its own, so the rows of the
    attempt that counts name complete blocks.
    """
    schema = pa.schema(
        [("dims", pa.int32()), ("label", pa.int32()), ("first_list", pa.int32()), ("first_id", pa.int64()), ("path", pa.string()), ("start", pa.int64()), ("length", pa.int32())]
    )
    shared = placed.sparkSession.sparkContext.broadcast(quantisers)
    most_rows, most_bytes = CHUNK_ROWS, CHUNK_BYTES

    def blocks(batches) -> Iterator[tuple[tuple, list[tuple]]]:
        for key, rows in by_group(rows_of(batches), 2):
            at_once = max(1, min(most_rows, most_bytes // (8 * key[0])))
            block = []
            for row in rows:
                block.append(row)
                if len(block) == at_once:
                    yield key, block
                    block = []
            if block:
                yield key, block

    def run(batches):
        fs, root = store(folder)
        name, stream, written = f"{uuid.uuid4().hex}.blocks", None, []
        try:
            for (dims, label), rows in blocks(batches):
                if stream is None:
                    fs.create_dir(root, recursive=True)
                    stream = fs.open_output_stream(f"{root}/{name}", compression=None)
                start, data = stream.tell(), _packed(shared.value[dims], rows, kind)
                stream.write(data)
                written.append((dims, label, rows[0][0], rows[0][1], f"{folder}/{name}", start, len(data)))
        finally:
            if stream is not None:
                stream.close()
        if written:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in written], schema)

    order = ["dims", "label", "list", "id"]
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order, "vector")
    return settle(dealt.mapInArrow(run, BLOCKS), "vector-blocks")


def linked_pairs(quantiser: Quantiser, first: Block, second: Block | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked rows: one of ``first``, one of ``second``.

    ``second`` holds no list before those of ``first``, and is None for the
    pairs within ``first``.
    """
    other = second or first
    found = [], []
    norm_a, norm_b = np.sqrt((first.raw**2).sum(1)), np.sqrt((other.raw**2).sum(1))
    lists, starts = np.unique(other.home, return_index=True)
    ends = np.append(starts[1:], len(other.home))
    probed = [quantiser.probes(first.units[a : a + VISITORS], first.home[a : a + VISITORS], lists) for a in range(0, len(first.home), VISITORS)]
    row = np.concatenate([r + a * VISITORS for a, (r, _) in enumerate(probed)])
    visited = np.concatenate([v for _, v in probed])
    by_list = np.argsort(visited, kind="stable")
    row, cuts = row[by_list], np.searchsorted(visited[by_list], np.append(lists, len(quantiser.centroids)))
    for k, number in enumerate(lists.tolist()):
        members = np.flatnonzero(first.home == number)
        visitors = np.concatenate([row[cuts[k] : cuts[k + 1]], members])
        target = np.arange(starts[k], ends[k])
        for a in range(0, len(visitors), VISITORS):
            own = visitors[a : a + VISITORS]
            far = quantiser.table_distances(first.units[own] - quantiser.centroids[number], other.codes[target])
            i, j = np.nonzero(far <= REACH + other.errors[target][None, :])
            i, j = own[i], target[j]
            if second is None:  # members of a list meet twice
                once = (i < j) | (first.home[i] != number)
                i, j = i[once], j[once]
            for p in range(0, len(i), PAIRS):
                x, y = i[p : p + PAIRS], j[p : p + PAIRS]
                cosine = np.einsum("ij,ij->i", first.raw[x], other.raw[y]) / (norm_a[x] * norm_b[y])
                found[0].append(x[cosine >= THRESHOLD])
                found[1].append(y[cosine >= THRESHOLD])
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(found[0] or none), np.concatenate(found[1] or none)


def link_vectors(blocks: DataFrame, quantisers: dict[int, Quantiser], kind: str) -> DataFrame:
    """Rows of ``LINKS`` over all pairs of blocks of a label.

    A pair of blocks is a short row that stands for much work, so the number of
    tasks is given.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(quantisers)

    def compare(batches):
        held: tuple = (None, None)
        for dims, *places in rows_of(batches):
            one, two = places[:3], places[3:]

            def read(path, start, length, dims=dims):
                fs, inner = store(path)
                with fs.open_input_file(inner) as file:
                    return _unpacked(file.read_at(length, start), dims, kind)

            if held[0] != one:
                held = (one, read(*one))
            first, second = held[1], None if one == two else read(*two)
            left, right = linked_pairs(shared.value[dims], first, second)
            if len(left):
                ids, sizes = (first.ids, first.sizes) if second is None else (np.concatenate([first.ids, second.ids]), np.concatenate([first.sizes, second.sizes]))
                yield link_summary(ids, sizes, left, right if second is None else right + len(first.ids))

    place = ["path", "start", "length"]
    order = F.struct("first_list", "first_id", *place)
    one = blocks.select("dims", "label", *[F.col(c).alias(f"a_{c}") for c in place], order.alias("a"))
    two = blocks.select("dims", "label", *[F.col(c).alias(f"b_{c}") for c in place], order.alias("b"))
    per_group = blocks.groupBy("dims", "label").count()
    pairs = per_group.agg(F.sum(F.col("count") * (F.col("count") + 1) / 2)).first()[0] or 1
    met = one.join(two, ["dims", "label"]).filter("a <= b").select("dims", *[f"a_{c}" for c in place], *[f"b_{c}" for c in place])
    dealt = met.repartition(int(min(pairs, MOST_TASKS))).sortWithinPartitions("a_path", "a_start")
    return dealt.mapInArrow(compare, LINKS)


def similar_vectors(vectors: DataFrame) -> DataFrame:
    """One row per vector: vec_id, label, n_links, component_id, kept.

    Vectors with equal labels link if their cosine is at least 0.98.
    ``n_links`` counts the other vectors linked directly, ``component_id`` is
    the smallest vec_id reachable, ``kept`` whether that is the vector itself.

    Vectors that are null, empty, zero or hold a null or non-finite component,
    or have a null label or id, link with nothing, and neither do vectors of
    different lengths. Equal vectors are compared once. Rows that repeat a
    vec_id count as vectors. An empty table gives no rows. Further columns are
    ignored.
    """
    spark, kind = vectors.sparkSession, number_type(vectors)
    usable = settle(usable_vectors(vectors), "vectors")
    # equal vectors go by their digest from here on, so that vectors move only to be grouped and to be filed
    keys = settle(usable.select("vec_id", "label", F.unhex(F.sha2("vector", 256)).alias("digest")), "vector-keys")
    same = usable.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("size"))
    classes = settle(same, "vector-classes")
    discard(usable)
    sizes = classes.groupBy((F.octet_length("vector") / np.dtype(kind).itemsize).cast("int").alias("dims"))
    counts = {r[0]: r[1] // r[2] for r in sizes.agg(F.count(F.lit(1)), F.count_distinct("label")).collect()}
    quantisers = {dims: fit(classes, dims, n, kind) for dims, n in sorted(counts.items())}
    folder = new_folder(spark, "vector-files")
    delete_at_end(spark, folder)
    blocks = write_blocks(file_vectors(classes, quantisers, kind), quantisers, kind, folder)
    discard(classes)
    links = settle(link_vectors(blocks, quantisers, kind), "vector-links")
    remove_folder(spark, folder)
    counted = links.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("id").alias("u"), F.col("root").alias("v")))
    groups = keys.groupBy("label", "digest").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("size"))
    judged = (
        groups.join(counted, "id", "left")
        .join(roots, "id", "left")
        .select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    known = keys.join(judged, ["label", "digest"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("int").alias("label"))
    component = F.coalesce("component_id", "vec_id")
    return rows.join(known, "vec_id", "left").select(
        "vec_id", "label", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept")
    )
