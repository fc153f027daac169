"""Token ids in binary files, entropy-coded by range asymmetric numeral systems.

One frequency table, counted over all documents, is shared by every file. A
file holds blocks of whole documents; a block is a directory of documents and
a sequence of segments. A segment is coded on its own: its tokens are dealt
over interleaved lanes with a state each, which numpy codes side by side. The
start of a segment is a checkpoint (states, word count, checksum), the footer
lists the blocks, so blocks decode in parallel and damage stays in a segment.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstar.llm import shards
from tillstar.llm.common import key_bounds, map_sorted_groups, range_of, rows_of, store
from tillstar.llm.tokens import ByteEncoder, encoder, vocabulary_path
from tillstar.session import delete_at_end, discard, new_folder, settle

VOCABULARY, VOCABULARY_SIZE, END_ID = "byte_bpe_50k.json", 50_257, 0
#: Text bytes of a shard; tokens after which a block or a segment is closed; lanes of a segment.
SHARD_BYTES, BLOCK_TOKENS, SEGMENT_TOKENS, LANES = 8 << 20, 1 << 18, 1 << 18, 1024
#: Frequencies add up to 2 ** SCALE; states stay in [2 ** 31, 2 ** 63).
SCALE, LOW = 20, 31

MAGIC, BLOCK_MAGIC = b"TRANS1\0\0", 0x4B4C4254
_BLOCK, _ENTRY, _SEGMENT, _FOOTER = "<IIQQI", "<?qQ", "<IIII", "<QQ8s"

DOCUMENTS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, file string"


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies of every id, each at least 1, with the sum 2 ** SCALE."""
    room = (1 << SCALE) - len(counts)
    total = int(counts.sum())
    share = np.array([int(c) * room // total for c in counts.tolist()], dtype=np.uint64) if total else np.zeros(len(counts), np.uint64)
    frequencies = share + np.uint64(1)
    frequencies[int(np.argmax(frequencies))] += np.uint64((1 << SCALE) - int(frequencies.sum()))
    return frequencies


class Coder:
    """Encodes and decodes segments with one frequency table."""

    def __init__(self, frequencies: np.ndarray):
        self.f = frequencies.astype(np.uint64)
        self.c = np.cumsum(self.f) - self.f
        self.symbol = np.repeat(np.arange(len(self.f), dtype=np.uint16), self.f.astype(np.int64))

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        f, c = self.f[ids], self.c[ids]
        most = f << np.uint64(32 + LOW - SCALE)
        states = np.full(LANES, 1 << LOW, dtype=np.uint64)
        words: list[np.ndarray] = []
        for a in range((n - 1) // LANES * LANES, -1, -LANES):
            b = min(a + LANES, n)
            x = states[: b - a]
            full = x >= most[a:b]
            if full.any():
                words.append(x[full].astype(np.uint32))
                x[full] >>= np.uint64(32)
            q = x // f[a:b]
            x[:] = (q << np.uint64(SCALE)) + (x - q * f[a:b]) + c[a:b]
        coded = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        head = struct.pack(_SEGMENT, n, LANES, len(coded), zlib.crc32(ids.astype("<u4").tobytes()))
        return head + states.astype("<u8").tobytes() + coded.astype("<u4").tobytes()

    def decode(self, data: memoryview) -> tuple[np.ndarray, int]:
        """The ids of the segment at the start of ``data`` and its length in bytes."""
        n, lanes, n_words, crc = struct.unpack_from(_SEGMENT, data)
        at = struct.calcsize(_SEGMENT)
        states = np.frombuffer(data, "<u8", lanes, at).copy()
        at += 8 * lanes
        words = np.frombuffer(data, "<u4", n_words, at).astype(np.uint64)
        ids = np.empty(n, dtype=np.uint16)
        mask, used = np.uint64((1 << SCALE) - 1), 0
        for a in range(0, n, lanes):
            b = min(a + lanes, n)
            x = states[: b - a]
            slot = x & mask
            ids[a:b] = symbols = self.symbol[slot]
            x[:] = self.f[symbols] * (x >> np.uint64(SCALE)) + slot - self.c[symbols]
            low = x < np.uint64(1 << LOW)
            k = int(low.sum())
            if k:
                x[low] = (x[low] << np.uint64(32)) | words[used : used + k]
                used += k
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc or used != n_words:
            raise ValueError("checksum of a segment differs")
        return ids, at + 4 * n_words


def encode_block(coder: Coder, start: int, docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """``docs`` are (doc_id, ids); ``start`` is the number of ids before the block."""
    directory = b"".join(struct.pack(_ENTRY, d is not None, d or 0, len(ids)) for d, ids in docs)
    ids = np.concatenate([ids for _, ids in docs])
    segments = [coder.encode(ids[a : a + SEGMENT_TOKENS]) for a in range(0, len(ids), SEGMENT_TOKENS)]
    return struct.pack(_BLOCK, BLOCK_MAGIC, len(docs), len(ids), start, len(segments)) + directory + b"".join(segments)


def decode_block(coder: Coder, data: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start, ids) of each document of a block."""
    magic, n_docs, n_tokens, start, n_segments = struct.unpack_from(_BLOCK, data)
    if magic != BLOCK_MAGIC:
        raise ValueError("not a block")
    view, at = memoryview(data), struct.calcsize(_BLOCK)
    size = n_docs * struct.calcsize(_ENTRY)
    directory = list(struct.iter_unpack(_ENTRY, view[at : at + size]))
    at += size
    parts = []
    for _ in range(n_segments):
        ids, size = coder.decode(view[at:])
        parts.append(ids)
        at += size
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint16)
    if len(ids) != n_tokens:
        raise ValueError("a block has lost tokens")
    at = 0
    for known, doc_id, n in directory:
        yield (doc_id if known else None), start + at, ids[at : at + n]
        at += n


def encode_texts(docs: DataFrame, bounds: np.ndarray, vocabulary: str) -> DataFrame:
    """shard, doc_id, n_tokens, ids (16-bit, end id included) of each document."""
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    end = np.array([END_ID], dtype="<u2").tobytes()

    def run(batches):
        texts = encoder(ByteEncoder, vocabulary)
        for batch in batches:
            ids = [x.astype("<u2").tobytes() + end for x in texts.encode(batch.column(1))]
            counts = pa.array([len(x) // 2 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(range_of(batch.column(0), bounds)), batch.column(0), counts, pa.array(ids, pa.binary())], schema=schema
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "shard int, doc_id bigint, n_tokens bigint, ids binary")


def count_ids(coded: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all documents; one row per id reaches the driver."""

    def run(batches):
        counts = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for (ids,) in rows_of([batch]):
                counts += np.bincount(np.frombuffer(ids, "<u2"), minlength=size)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], ["id", "n"])

    summed = coded.select("ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, dtype=np.int64)
    for i, n in summed.collect():
        counts[i] = n
    return counts


def _writer(folder: str, frequencies: np.ndarray, bases: dict[int, int]):
    def write(groups):
        coder = Coder(frequencies)
        for (shard,), rows in groups:
            file = shards.ShardFile(folder, f"tokens-{shard:05d}.rans")
            file.write(MAGIC)
            blocks, pending, waiting, start = [], [], 0, bases[shard]
            for doc_id, ids in rows:
                pending.append((doc_id, np.frombuffer(ids, "<u2")))
                waiting += len(ids) // 2
                if waiting >= BLOCK_TOKENS:
                    blocks.append(file.bytes)
                    file.write(encode_block(coder, start, pending), len(pending))
                    pending, start, waiting = [], start + waiting, 0
            if pending:
                blocks.append(file.bytes)
                file.write(encode_block(coder, start, pending), len(pending))
            at = file.bytes
            blocks.append(at)
            file.write(np.array(blocks, "<u8").tobytes() + struct.pack(_FOOTER, len(blocks), at, MAGIC))
            yield shards.manifest_batch([file.close()])

    return write


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, per_shard: int = SHARD_BYTES) -> DataFrame:
    """Encode all texts in ascending doc_id order into files below ``folder``.

    Every document is followed by the end id 0. Null texts are empty; null
    doc_ids come first; documents that share a doc_id follow each other in the
    order of their ids. An empty table writes no file. Further columns are
    ignored. Returns the manifest.
    """
    sized = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 2).cast("bigint").alias("weight"))
    bounds = key_bounds(sized, "doc_id", "weight", per_shard)
    coded = settle(encode_texts(docs, bounds, vocabulary), "token-ids")
    frequencies = scaled(count_ids(coded, VOCABULARY_SIZE))
    bases, start = {}, 0
    for shard, n in sorted(coded.groupBy("shard").agg(F.sum("n_tokens")).collect()):
        bases[shard], start = start, start + n
    written = map_sorted_groups(coded.select("shard", "doc_id", "ids"), ["shard"], ["doc_id", "ids"], _writer(folder, frequencies, bases), shards.MANIFEST)
    manifest = shards.commit(written, folder)
    fs, root = store(folder)
    with fs.open_output_stream(f"{root}/frequencies.u4") as stream:
        stream.write(frequencies.astype("<u4").tobytes())
    discard(coded)
    return manifest


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, file of each document, from the files."""

    def blocks(path, fs, inner):
        with fs.open_input_file(inner) as file:
            file.seek(file.size() - struct.calcsize(_FOOTER))
            n, at, magic = struct.unpack(_FOOTER, file.read())
            if magic != MAGIC:
                raise ValueError(f"{path} has no footer")
            file.seek(at)
            offsets = np.frombuffer(file.read(8 * n), "<u8")
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([a]), pa.array([b - a])], ["path", "at", "size"])

    def decode(batches):
        coder = None
        for path, at, size in rows_of(batches):
            fs, inner = store(path)
            if coder is None:
                root = inner.rpartition("/")[0]
                with fs.open_input_stream(f"{root}/frequencies.u4") as table:
                    coder = Coder(np.frombuffer(table.read(), "<u4"))
            with fs.open_input_file(inner) as file:
                file.seek(at)
                data = file.read(size)
            rows = [
                (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), inner.rpartition("/")[2])
                for doc_id, start, ids in decode_block(coder, data)
            ]
            names, kinds = ["doc_id", "start", "n_tokens", "ids_crc32", "file"], [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    listed = shards.read_files(manifest, blocks, "path string, at bigint, size bigint")
    tasks = min(max(manifest.count(), 1), shards.MOST_TASKS)
    return listed.repartition(tasks, "path", "at").mapInArrow(decode, DOCUMENTS)


def token_round_trip(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write all documents' ids to files in the shared folder, which go with
    the application, and read them back."""
    folder = new_folder(spark, "tokens")
    manifest = write_tokens(docs, folder, vocabulary or vocabulary_path(VOCABULARY))
    delete_at_end(spark, folder)
    return read_tokens(manifest, folder)
