"""Alignment of two tokenizers' tokens by merge-path partitioning.

Both tokenizers cut the same bytes, so a document is two rising lists of token
ends. The lists of a chunk of documents are merged in independent pieces of
equal work: a piece's corners on the merge path are found by binary search
along diagonals, and inside it every token meets the tokens it overlaps. Ends
that both have close a group; a group that goes on past a piece is stitched by
carrying the number of groups closed before.

Which pairs of ids belong together is a matter of the whole corpus: a chunk
counts its linked pairs, Spark adds the counts up, and each chunk gets back the
totals of the pairs that it has.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstar.llm.common import slices_by_bytes
from tillstar.llm.pieces import VOCABULARY as PIECE_VOCABULARY
from tillstar.llm.pieces import codec
from tillstar.llm.tokens import ByteEncoder, bytes_of, encoder, vocabulary_path
from tillstar.session import settle

BYTE_VOCABULARY = "byte_bpe_50k.json"
#: Text bytes of a chunk, and ends of both tokenizers merged in one piece.
CHUNK_BYTES, PIECE_ENDS = 8 << 20, 1 << 16

ALIGNED = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
    "groups_sha256 string, n_overlaps bigint"
)
#: A chunk's documents, with the numbers of their links' pairs, and its pairs in order.
_ROWS = (
    "chunk bigint, pair bigint, n bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_overlaps bigint, groups_sha256 string, links binary"
)
_NAMES = [column.split(" ")[0] for column in ALIGNED.split(", ")]


def path_corners(a: np.ndarray, b: np.ndarray, step: int = PIECE_ENDS) -> list[tuple[int, int]]:
    """Where the merge path of two sorted lists crosses every ``step``-th diagonal.

    (i, j) says that the first i + j merged items are i of ``a`` and j of
    ``b``; of equal items that of ``a`` comes first. All diagonals are searched
    at once, each by halving the range of i.
    """
    n = len(a) + len(b)
    diagonal = np.append(np.arange(0, n, step), n)
    low, high = np.maximum(diagonal - len(b), 0), np.minimum(diagonal, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        at_a, at_b = middle[open_], (diagonal - middle - 1)[open_]
        more = a[at_a] <= b[at_b]  # then a's item is on this side of the diagonal
        low[open_] = np.where(more, at_a + 1, low[open_])
        high[open_] = np.where(more, high[open_], at_a)
    return list(zip(low.tolist(), (diagonal - low).tolist(), strict=True))


def piece_overlaps(a: np.ndarray, b: np.ndarray, corner: tuple[int, int], following: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The overlaps that end in one piece: token of a, token of b, whether both end there.

    A piece looks at one item of each list past its corners, as an end may be
    the last of this piece in the one list and the first of the next in the other.
    """
    (i, j), (next_i, next_j) = corner, following
    own_a, own_b = a[i:next_i], b[j:next_j]
    partner = j + np.searchsorted(b[j : next_j + 1], own_a)
    together = np.zeros(len(own_a), dtype=bool)
    inside = partner < len(b)
    together[inside] = b[partner[inside]] == own_a[inside]
    # ends of b alone; one that equals an end of a just before the corner is that one's overlap
    before = max(i - 1, 0)
    upto = before + np.searchsorted(a[before:next_i], own_b)
    alone = np.ones(len(own_b), dtype=bool)
    known = upto < next_i
    alone[known] = a[upto[known]] != own_b[known]
    return (
        np.concatenate([np.arange(i, next_i), upto[alone]]),
        np.concatenate([partner, j + np.flatnonzero(alone)]),
        np.concatenate([together, np.zeros(int(alone.sum()), dtype=bool)]),
    )


def merge_ends(a: np.ndarray, b: np.ndarray, step: int = PIECE_ENDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(overlaps of each token of a, its token of b that ends with it or -1, groups closed before it).

    Both lists rise and end alike. Pieces are merged one by one; the groups a
    piece has closed shift those of the next, which stitches the group that is
    open between them.
    """
    corners = path_corners(a, b, step)
    overlaps, partner = np.zeros(len(a), dtype=np.int64), np.full(len(a), -1, dtype=np.int64)
    group, closed = np.zeros(len(a), dtype=np.int64), 0
    for corner, following in zip(corners[:-1], corners[1:], strict=True):
        of_a, of_b, together = piece_overlaps(a, b, corner, following)
        np.add.at(overlaps, of_a, 1)
        partner[of_a[together]] = of_b[together]
        own = slice(corner[0], following[0])
        closing = np.cumsum(partner[own] >= 0)
        group[own] = closed + closing - (partner[own] >= 0)
        closed += int(closing[-1]) if len(closing) else 0
    return overlaps, partner, group


class Aligner:
    """Aligns the texts of an Arrow column; made once per worker process."""

    def __init__(self, bytes_path: str, pieces_path: str):
        self.a, self.b = encoder(ByteEncoder, bytes_path, True), codec(pieces_path)
        byte_of = {letter: byte for byte, letter in self.a.letters.items()}
        texts = [b""] * self.a.library.get_vocab_size()
        for token, i in self.a.vocabulary.items():
            texts[i] = bytes(byte_of[letter] for letter in token)
        self.texts_a = pa.array(texts, pa.large_binary())
        self.sizes_a = np.array([len(t) for t in texts], dtype=np.int64)
        self.sizes_b = pc.binary_length(self.b.texts).to_numpy().astype(np.int64)
        n = self.first_b = len(texts)
        names = [f"{i}{mark}" for i in range(n) for mark in ",|"] + [f"{i}{mark}" for i in range(self.b.size) for mark in ",;"]
        self.names = pa.array(names, pa.large_string())

    def _same(self, ids: np.ndarray, ends: np.ndarray, sizes: np.ndarray, texts: pa.Array, wanted: np.ndarray, wanted_ends: np.ndarray) -> np.ndarray:
        """Which documents' tokens join to the wanted bytes."""
        upto = np.concatenate([[0], np.cumsum(sizes[ids])])[ends]
        if np.array_equal(upto, wanted_ends):
            data, _ = bytes_of(texts.take(pa.array(ids)))
            if np.array_equal(data, wanted):
                return np.ones(len(ends), dtype=bool)
            wrong = np.concatenate([[0], np.cumsum(data != wanted)])
            return wrong[wanted_ends] == wrong[np.concatenate([[0], wanted_ends[:-1]])]
        data, _ = bytes_of(texts.take(pa.array(ids)))
        begins, starts = np.concatenate([[0], upto[:-1]]), np.concatenate([[0], wanted_ends[:-1]])
        return np.array(
            [np.array_equal(data[a:b], wanted[c:d]) for a, b, c, d in zip(begins, upto, starts, wanted_ends, strict=True)], dtype=bool
        )

    def chunk(self, number: int, doc_ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        """The rows of ``_ROWS`` of one chunk; texts are not null."""
        spaced = pc.binary_join_element_wise("", texts, " ")
        full = pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
        ids_a, ends_a = self.a.encode_slice(spaced)
        ids_b, ends_b = self.b.encode_slice(texts, check=False)
        wanted, wanted_ends = bytes_of(spaced.cast(pa.large_string()))
        usable = (
            full
            & self._same(ids_a, ends_a, self.sizes_a, self.texts_a, wanted, wanted_ends)
            & self._same(ids_b, ends_b, self.sizes_b, self.b.texts, wanted, wanted_ends)
        )
        n_a, n_b = (np.where(usable, np.diff(np.concatenate([[0], e])), 0) for e in (ends_a, ends_b))
        if not usable.all():
            ids_a = ids_a[np.repeat(usable, np.diff(np.concatenate([[0], ends_a])))]
            ids_b = ids_b[np.repeat(usable, np.diff(np.concatenate([[0], ends_b])))]
        doc_a, doc_b = np.cumsum(n_a), np.cumsum(n_b)
        overlaps, partner, group_a = merge_ends(np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b]))
        last_a = np.flatnonzero(partner >= 0)  # of each group
        last_b = partner[last_a]
        groups = np.searchsorted(last_a, doc_a, side="left")  # groups closed up to each document's end
        linked = (ids_a[last_a].astype(np.int64) << 16) | ids_b[last_b]
        coded = pa.array(linked).dictionary_encode()
        pairs = coded.dictionary.to_numpy()
        order = np.argsort(pairs)
        rank = np.empty(len(pairs), dtype="<u2" if len(pairs) <= 1 << 16 else "<u4")
        rank[order] = np.arange(len(pairs))
        links = rank[coded.indices.to_numpy()]
        counts = np.bincount(links, minlength=len(pairs))
        upto = np.concatenate([[0], groups])
        yield _rows(
            len(texts), chunk=np.full(len(texts), number), doc_id=doc_ids, n_a=n_a, n_b=n_b, n_groups=np.diff(upto),
            n_overlaps=np.diff(np.concatenate([[0], np.cumsum(overlaps)])[np.concatenate([[0], doc_a])]),
            groups_sha256=list(self._digests(ids_a, ids_b, group_a, last_a, last_b, doc_a, doc_b)),
            links=[own.tobytes() for own in np.split(links, groups[:-1])],
        )
        yield _rows(len(pairs), chunk=np.full(len(pairs), number), pair=pairs[order], n=counts)

    def _digests(self, ids_a, ids_b, group_a, last_a, last_b, doc_a, doc_b) -> Iterator[str]:
        # a's tokens of a group come after b's tokens of earlier groups, b's after a's of its own
        upto_b = np.concatenate([[0], last_b + 1])
        group_b = np.repeat(np.arange(len(last_b)), np.diff(upto_b))
        codes = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        closes_a, closes_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
        closes_a[last_a], closes_b[last_b] = 1, 1
        codes[np.arange(len(ids_a)) + upto_b[group_a]] = 2 * ids_a.astype(np.int64) + closes_a
        codes[np.arange(len(ids_b)) + (last_a + 1)[group_b]] = 2 * (ids_b.astype(np.int64) + self.first_b) + closes_b
        data, upto = bytes_of(self.names.take(pa.array(codes)))
        ends = np.concatenate([[0], upto])[doc_a + doc_b]
        view, begin = memoryview(np.ascontiguousarray(data)), 0
        for end in ends.tolist():
            yield hashlib.sha256(view[begin : end - 1]).hexdigest() if end > begin else ""
            begin = end


_made: dict[tuple[str, str], Aligner] = {}


def aligner(bytes_path: str, pieces_path: str) -> Aligner:
    if (bytes_path, pieces_path) not in _made:
        _made[bytes_path, pieces_path] = Aligner(bytes_path, pieces_path)
    return _made[bytes_path, pieces_path]


def _rows(size: int, **columns) -> pa.RecordBatch:
    """A batch of ``_ROWS``; columns that are not given are null."""
    kinds = {"groups_sha256": pa.string(), "links": pa.binary()}
    names = [column.split(" ")[0] for column in _ROWS.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[c], kinds.get(c, pa.int64())) if c in columns else pa.nulls(size, kinds.get(c, pa.int64())) for c in names], names
    )


def align_chunks(docs: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """Rows of ``_ROWS``: documents aligned, and the linked pairs of each chunk counted."""

    def run(batches):
        both, number = aligner(bytes_path, pieces_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for a, b in slices_by_bytes(texts, CHUNK_BYTES):
                yield from both.chunk(number, batch.column(0).slice(a, b - a), texts.slice(a, b - a))
                number += 1

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, _ROWS)


def pair_totals(rows: DataFrame) -> DataFrame:
    """pair, total, best: how many links of the corpus hold a pair, and whether
    none of its B id's pairs is held by more. A pair is a's id * 65536 + b's id."""
    counted = rows.filter("pair is not null").groupBy("pair").agg(F.sum("n").alias("total"))
    totals = settle(counted.withColumn("b", F.col("pair").bitwiseAND(0xFFFF)), "pair-totals")
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def _score(batches):
    """Rows of ``ALIGNED`` from the rows of whole chunks, pairs in order before documents."""
    chunk, totals, best = None, [], []
    for batch in batches:
        chunks = batch.column("chunk").to_numpy()
        borders = np.flatnonzero(np.diff(chunks)) + 1
        for a, b in itertools.pairwise([0, *borders.tolist(), len(batch)] if len(batch) else [0]):
            if chunks[a] != chunk:
                chunk, totals, best = chunks[a], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            part = batch.slice(a, b - a)
            n_pairs = len(part) - part.column("pair").null_count
            if n_pairs:
                totals.append(part.column("total").slice(0, n_pairs).to_numpy(zero_copy_only=False))
                best.append(part.column("best").slice(0, n_pairs).to_numpy(zero_copy_only=False).astype(np.int64))
            documents = part.slice(n_pairs)
            if len(documents):
                totals, best = [np.concatenate(totals)], [np.concatenate(best)]
                yield _scored(documents, totals[0], best[0])


def _scored(documents: pa.RecordBatch, totals: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    links = np.frombuffer(b"".join(documents.column("links").to_pylist()), "<u2" if len(totals) <= 1 << 16 else "<u4")
    n_a, n_b, groups = (documents.column(c).to_numpy() for c in ("n_a", "n_b", "n_groups"))
    ends = np.concatenate([[0], np.cumsum(groups)])
    sums, bests = (np.diff(np.concatenate([[0], np.cumsum(v[links])])[ends]) for v in (totals, best))
    columns = [documents.column("doc_id"), n_a, n_b, groups, groups, bests, sums, documents.column("groups_sha256"), documents.column("n_overlaps")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], _NAMES)


def align_documents(docs: DataFrame, bytes_path: str | None = None, pieces_path: str | None = None) -> DataFrame:
    """Rows of ``ALIGNED``, one per document.

    A is the byte-level vocabulary on the text after a space, B the piece
    vocabulary, which adds the space. ``n_groups`` counts the stretches between
    byte offsets where tokens of both end, ``n_links`` the pairs of tokens that
    end together, ``n_overlaps`` those that share a byte. ``count_sum`` adds up
    how many links of all documents hold the same pair of ids, ``n_best`` counts
    the links whose pair no other pair of its B id exceeds, ties included.

    Null and empty texts, and texts that the tokens of A or B do not spell, have
    no tokens. Documents count one by one, so rows that repeat an id or a text,
    or have a null id, are rows of the result and add to the counts. An empty
    table gives no rows; further columns are ignored.
    """
    bytes_path = bytes_path or vocabulary_path(BYTE_VOCABULARY)
    rows = settle(align_chunks(docs, bytes_path, pieces_path or vocabulary_path(PIECE_VOCABULARY)), "aligned")
    known = rows.filter("pair is not null").select("chunk", "pair").join(pair_totals(rows), "pair")
    both = known.unionByName(rows.filter("pair is null").drop("pair", "n"), allowMissingColumns=True)
    dealt = both.repartition("chunk").sortWithinPartitions("chunk", F.asc_nulls_last("pair"))
    return dealt.mapInArrow(_score, ALIGNED)
