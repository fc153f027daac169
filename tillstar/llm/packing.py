"""Packing documents into token sequences by order-preserving dynamic programming.

The documents of a shard, in doc_id order, form one stream of ids. Cuts are
allowed at document ends, at sentence ends, and, where neither comes for long,
at evenly spaced ids. Each window between two cuts is a sequence; its cost is
the padding it needs plus a penalty for the document it truncates. The least
total cost is found by a sliding minimum: a monotone queue keeps the cuts that
can still start the best window.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstar.llm.common import key_bounds, map_sorted_groups, range_of
from tillstar.llm.tokens import WordEncoder, encoder, vocabulary_path

VOCABULARY, VOCABULARY_SIZE, END_ID, SEQUENCE_TOKENS = "word_bpe_49k.json", 49_408, 1, 2048
#: Text bytes of a shard, and tokens of a stretch of the stream that is solved at once.
SHARD_BYTES, STRETCH_TOKENS = 4 << 20, 1 << 18
#: Penalties, in tokens of padding, of a cut at a sentence end or within a
#: sentence; and the distance of cuts within a sentence.
SENTENCE_PENALTY, HARD_PENALTY, HARD_STEP = 8, 64, 256
#: Text that ends a sentence, fixed values.
SENTENCE_ENDS = (".", "!", "?", "…", "。", "！", "？")

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def sentence_end_ids(vocabulary: str) -> np.ndarray:
    """For each id, whether its text ends a sentence."""
    texts = encoder(WordEncoder, vocabulary)
    byte_of = {letter: byte for byte, letter in texts.letters.items()}
    found = np.zeros(VOCABULARY_SIZE, dtype=bool)
    for token, i in texts.library.get_vocab().items():
        plain = token.removesuffix("</w>")
        if all(letter in byte_of for letter in plain):
            text = bytes(byte_of[letter] for letter in plain).decode("utf-8", "replace")
            found[i] = text.endswith(SENTENCE_ENDS)
    return found


def allowed_cuts(doc_ends: np.ndarray, sentence_ends: np.ndarray, step: int = HARD_STEP) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a stream that may end a window and their penalties.

    ``doc_ends`` and ``sentence_ends`` are positions after an id, ascending.
    """
    soft = np.union1d(doc_ends, sentence_ends)
    before = np.concatenate([[0], soft[:-1]])
    inner = (soft - before - 1) // step  # cuts within each gap
    gap = np.repeat(np.arange(len(soft)), inner)
    nth = np.arange(len(gap)) - np.repeat(np.cumsum(inner) - inner, inner) + 1
    hard = before[gap] + nth * step
    positions = np.concatenate([soft, hard])
    penalties = np.concatenate(
        [np.where(np.isin(soft, doc_ends), 0, SENTENCE_PENALTY), np.full(len(hard), HARD_PENALTY)]
    )
    order = np.argsort(positions, kind="stable")
    return positions[order], penalties[order]


def best_cuts(positions: np.ndarray, penalties: np.ndarray, most: int = SEQUENCE_TOKENS) -> list[int]:
    """Window ends of least total cost; the last position always ends one.

    cost(i, j) = padding(p[j] - p[i]) + penalty[j], where a window of a length
    that is a power of two needs no padding and any other is padded to
    ``most``. The padded transitions are a sliding minimum of
    ``best[i] + p[i]``; the few exact lengths are looked up.
    """
    powers = [1 << k for k in range(most.bit_length()) if 1 << k < most]
    at = [0, *positions.tolist()]
    toll = [0, *penalties.tolist()]
    index = {p: i for i, p in enumerate(at)}
    best, came = [0] * len(at), [0] * len(at)
    queue: deque[int] = deque([0])
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0]] < here - most:
            queue.popleft()
        i = queue[0]
        least, source = best[i] + at[i] + most - here, i
        for power in powers:
            k = index.get(here - power)
            if k is not None and best[k] < least:
                least, source = best[k], k
        best[j], came[j] = least + (toll[j] if j < len(at) - 1 else 0), source
        value = best[j] + here
        while queue and best[queue[-1]] + at[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = came[j]
    return cuts[::-1]


def _pack(docs: list[tuple[int | None, np.ndarray, np.ndarray]], first_sequence: int) -> tuple[pa.RecordBatch, int]:
    """Pieces of one stretch; docs are (doc_id, ids, positions of sentence ends)."""
    sizes = np.array([len(ids) for _, ids, _ in docs])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    sentences = np.concatenate([s + b for (_, _, s), b in zip(docs, begins, strict=True)])
    cuts = np.array(best_cuts(*allowed_cuts(ends, sentences)))
    borders = np.union1d(cuts, ends)
    starts = np.concatenate([[0], borders[:-1]])
    doc = np.searchsorted(ends, starts, side="right")
    sequence = np.searchsorted(cuts, starts, side="right")
    opened = np.concatenate([[0], cuts[:-1]])[sequence]
    crcs = [
        zlib.crc32(docs[d][1][a - begins[d] : b - begins[d]].astype("<u4").tobytes())
        for d, a, b in zip(doc.tolist(), starts.tolist(), borders.tolist(), strict=True)
    ]
    columns = [
        pa.array([docs[d][0] for d in doc.tolist()], pa.int64()),
        pa.array(starts - begins[doc]), pa.array(borders - starts), pa.array(crcs, pa.int64()), pa.array(sizes[doc]),
        pa.array(first_sequence + sequence), pa.array(starts - opened),
    ]
    return pa.RecordBatch.from_arrays(columns, _NAMES), len(cuts)


def _packer(vocabulary: str):
    def pack(groups):
        ends_sentence = sentence_end_ids(vocabulary)
        for (shard,), rows in groups:
            docs, waiting, used = [], 0, shard << 40
            for doc_id, data in rows:
                ids = np.frombuffer(data, "<u2")
                docs.append((doc_id, ids, np.flatnonzero(ends_sentence[ids]) + 1))
                waiting += len(ids)
                if waiting >= STRETCH_TOKENS:
                    batch, n = _pack(docs, used)
                    docs, waiting, used = [], 0, used + n
                    yield batch
            if docs:
                yield _pack(docs, used)[0]

    return pack


def pack_documents(docs: DataFrame, vocabulary: str | None = None, per_shard: int = SHARD_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    The stream follows ascending doc_id; every document ends with the id 1.
    Each id lies in one piece, a sequence's pieces fill it from offset 0, and
    no sequence is longer than 2048.

    Null and empty texts are the end id alone; null doc_ids come first;
    documents that share a doc_id are packed one by one. A document longer
    than a sequence is cut at its sentence ends. An empty table gives no
    pieces. Further columns are ignored.
    """
    vocabulary = vocabulary or vocabulary_path(VOCABULARY)
    sized = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 4).cast("bigint").alias("weight"))
    bounds = key_bounds(sized, "doc_id", "weight", per_shard)
    end = np.array([END_ID], dtype="<u2").tobytes()

    def encode(batches):
        texts = encoder(WordEncoder, vocabulary)
        for batch in batches:
            ids = [x.astype("<u2").tobytes() + end for x in texts.encode(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range_of(batch.column(0), bounds)), batch.column(0), pa.array(ids, pa.binary())], ["shard", "doc_id", "ids"]
            )

    coded = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(encode, "shard int, doc_id bigint, ids binary")
    return map_sorted_groups(coded, ["shard"], ["doc_id", "ids"], _packer(vocabulary), PIECES)
