"""SentencePiece encoding and decoding for merge-type vocabularies.

Text is cut before each run of spaces that follows something else: no piece
has a space after another character, so nothing merges across. Every distinct
segment starts as its characters; the agenda merges the adjacent pair whose
piece scores highest, leftmost first, until no pair makes a piece. Characters
without a piece become their UTF-8 bytes. The segments of each Arrow batch are
checked against the ``sentencepiece`` library.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstar.llm.agenda import Merges, merge_words
from tillstar.llm.common import slices_by_bytes
from tillstar.llm.tokens import bytes_of, ragged, take, vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
#: Bytes of text encoded at once.
SLICE_BYTES = 8 << 20
#: What stands for a space in pieces.
SPACE = "▁"

DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def decimal_lists(ids: np.ndarray, ends: np.ndarray, decimals: pa.Array) -> Iterator[bytes]:
    """The ids of each list as decimal numbers joined by commas; ``decimals``
    holds each id followed by a comma."""
    data, upto = bytes_of(decimals.take(pa.array(ids)))
    upto, view, begin = np.concatenate([[0], upto]), memoryview(data), 0
    for end in upto[ends].tolist():
        yield view[begin : max(end - 1, begin)]
        begin = end


class PieceCodec:
    """Ids of texts and texts of ids for one vocabulary; made once per worker process."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = library.piece_size()
        if n > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        odd = " a\t b  éÉﬁ "
        if library.normalize(odd) != (" " + odd).replace(" ", SPACE):
            raise ValueError("this vocabulary normalises its text")
        names = [library.id_to_piece(i) for i in range(n)]
        special = [library.is_control(i) or library.is_unknown(i) for i in range(n)]
        in_bytes = [i for i in range(n) if library.is_byte(i)]
        if len(in_bytes) != 256 or any(library.is_unused(i) for i in range(n)):
            raise ValueError("only vocabularies with byte fallback and without unused pieces are supported")
        self.first_byte = in_bytes[0]
        self.special = np.array(special)
        merging = {p: i for i, p in enumerate(names) if not special[i] and not library.is_byte(i)}
        if any(SPACE in p.lstrip(SPACE) for p in merging):
            raise ValueError("pieces of this vocabulary go on after a space")
        # a character without a piece is a symbol of its own, beyond the ids
        self.symbol = np.arange(0x110000, dtype=np.int64) + n
        for p, i in merging.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        _, rank = np.unique(np.array([-library.get_score(i) for i in range(n)], dtype=np.float32), return_inverse=True)

        def symbol(part: str) -> int | None:
            return int(self.symbol[ord(part)]) if len(part) == 1 else merging.get(part)

        rows = [
            (symbol(p[:k]), symbol(p[k:]), int(rank[i]), i)
            for p, i in merging.items()
            for k in range(1, len(p))
            if symbol(p[:k]) is not None and symbol(p[k:]) is not None
        ]
        self.merges = Merges(*np.array(rows, dtype=np.int64).T)
        texts = [
            b"" if special[i] else bytes([i - self.first_byte]) if library.is_byte(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(names)
        ]
        self.texts = pa.array(texts, pa.large_binary())
        self.decimals = pa.array([f"{i}," for i in range(n)], pa.large_string())

    def _segments(self, segments: pa.Array) -> pa.Array:
        """Ids of distinct segments, each the text after its first space."""
        if not len(segments):
            return ragged(np.zeros(0), np.zeros(0, dtype=np.int64))
        joined = pc.binary_join_element_wise(" ", segments, "")
        data, _ = bytes_of(joined)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4")
        points = np.where(points == 32, ord(SPACE), points)
        ends = np.cumsum(pc.utf8_length(joined).to_numpy().astype(np.int64))
        symbols, ends = merge_words(self.symbol[points], ends, self.merges)
        return self._with_bytes(symbols, ends)

    def _with_bytes(self, symbols: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Ids, with the bytes of each character that is no piece."""
        lone = np.flatnonzero(symbols >= self.size)
        if not len(lone):
            return ragged(symbols, ends)
        point = symbols[lone].astype(np.int64) - self.size
        sizes = np.ones(len(symbols), dtype=np.int64)
        sizes[lone] = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
        upto = np.cumsum(sizes)
        ids = np.repeat(symbols, sizes)
        data = np.frombuffer("".join(map(chr, point.tolist())).encode(), dtype=np.uint8)
        at = np.repeat(upto[lone] - sizes[lone], sizes[lone])
        inner = np.arange(len(data)) - np.repeat(np.cumsum(sizes[lone]) - sizes[lone], sizes[lone])
        ids[at + inner] = data.astype(np.int64) + self.first_byte
        return ragged(ids, np.concatenate([[0], upto])[ends])

    def _check(self, segments: pa.Array, found: pa.Array) -> None:
        ids, ends = take(found, np.arange(len(found)))
        wanted = self.library.encode(segments.to_pylist(), num_threads=1)
        for i in np.flatnonzero(pc.equal(segments, "").to_numpy(zero_copy_only=False)).tolist():
            wanted[i] = self.library.encode("a ")[1:]  # a space that ends a text
        sizes = np.cumsum([len(w) for w in wanted], dtype=np.int64)
        if not np.array_equal(sizes, ends) or not np.array_equal(ids, np.fromiter(itertools.chain.from_iterable(wanted), "<u2", len(ids))):
            raise ValueError("the ids differ from those of the sentencepiece library")

    def encode_slice(self, texts: pa.Array, check: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and each text's end; no nulls."""
        split = pc.split_pattern(pc.replace_substring(texts, SPACE, " "), " ")
        text_ends = split.offsets.to_numpy()[1:].astype(np.int64) - split.offsets[0].as_py()
        parts = split.flatten()
        coded = parts.dictionary_encode()
        distinct, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        empty = np.flatnonzero(pc.equal(distinct, "").to_numpy(zero_copy_only=False))
        if len(empty):
            codes, distinct = self._spaced(codes, distinct, int(empty[0]), text_ends, pc.equal(texts, "").to_numpy(zero_copy_only=False))
        lists = self._segments(distinct)
        if check:
            self._check(distinct, lists)
        if len(empty):  # what closes no segment has no ids of its own
            lists = pa.concat_arrays([lists, ragged(np.zeros(0), np.zeros(1, dtype=np.int64))])
        ids, ends = take(lists, codes)
        return ids, np.concatenate([[0], ends])[text_ends]

    def _spaced(self, codes, distinct, empty, text_ends, no_text):
        """Segments that begin with several spaces, or are nothing else.

        An empty part stands for a space; a run of them goes with the part that
        ends it, or with the end of the text. Returns the parts' segment
        numbers, the last of which means none, and all segments.
        """
        blank = codes == empty
        last = np.zeros(len(codes), dtype=bool)
        last[text_ends - 1] = True
        closes = ~blank | last
        of_text = np.repeat(np.arange(len(text_ends)), np.diff(np.concatenate([[0], text_ends])))
        ended = np.flatnonzero(closes)
        spaces = np.diff(np.concatenate([[-1], ended]))
        several = (spaces > 1) | blank[ended]
        rows = ended[several]
        # an empty text has one empty part and no space before it
        rows_spaces = np.where(no_text[of_text[rows]], 0, spaces[several])
        pairs, numbers = np.unique(np.stack([codes[rows], rows_spaces]), axis=1, return_inverse=True)
        texts = distinct.to_pylist() if pairs.shape[1] > 1000 else None
        fresh = [" " * (int(k) - 1) + (texts[c] if texts else distinct[c].as_py()) if k else None for c, k in pairs.T.tolist()]
        kept = np.flatnonzero(np.array([f is not None for f in fresh], dtype=bool))
        place = np.full(len(fresh), len(distinct) + len(kept))
        place[kept] = len(distinct) + np.arange(len(kept))
        codes = codes.copy()
        codes[~closes] = len(distinct) + len(kept)
        codes[rows] = place[numbers.reshape(-1)]
        return codes, pa.concat_arrays([distinct, pa.array([fresh[k] for k in kept.tolist()], distinct.type)])

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, ids, each text's end) for slices of a column; null is empty."""
        texts = texts.fill_null("")
        for a, b in slices_by_bytes(texts, SLICE_BYTES):
            yield a, b, *self.encode_slice(texts.slice(a, b - a))

    def decode_slice(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each list of ids.

        The pieces' texts one after the other, without the space that encoding
        put first. Lists with control ids or with bytes that are no text are
        left to the library, which knows what to put in their place.
        """
        data, upto = bytes_of(self.texts.take(pa.array(ids)))
        upto = np.concatenate([[0], upto])
        starts = np.concatenate([[0], ends[:-1]])
        raw, found = data.tobytes(), []
        odd = self.special[ids]
        some_odd = np.concatenate([[0], np.cumsum(odd)])
        begins, finals, filled = upto[starts], upto[ends], ends > starts
        first = np.zeros(len(ends), dtype=bool)
        first[filled] = data[np.minimum(begins[filled], len(data) - 1)] == 32 if len(data) else False
        first[filled] &= ids[starts[filled]] != self.first_byte + 32
        dirty = some_odd[ends] > some_odd[starts]
        for i, (a, b, space) in enumerate(zip(begins.tolist(), finals.tolist(), first.tolist(), strict=True)):
            text = raw[a + space : b]
            if dirty[i] or not _is_text(text):
                text = self.library.decode(ids[starts[i] : ends[i]].tolist()).encode()
            found.append(text)
        return found


def _is_text(data: bytes) -> bool:
    if data.isascii():
        return True
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


_made: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """The worker's codec for a vocabulary file."""
    if path not in _made:
        _made[path] = PieceCodec(path)
    return _made[path]


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids (16-bit integers, little-endian) of each document.

    Null and empty texts have no ids. Documents are encoded one by one, so null
    and repeated doc_ids and repeated texts come out as they went in; an empty
    table gives no rows; further columns are ignored.
    """
    path = vocabulary or vocabulary_path(VOCABULARY)

    def run(batches):
        pieces = codec(path)
        for batch in batches:
            for a, b, ids, ends in pieces.encode(batch.column(1)):
                lists = ragged(ids, ends).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, ids binary")


def decode_documents(coded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, text of each row of ``encode_documents``; null ids are none."""
    path = vocabulary or vocabulary_path(VOCABULARY)

    def run(batches):
        pieces = codec(path)
        for batch in batches:
            lists = batch.column(1).fill_null(b"").cast(pa.large_binary())
            for a, b in slices_by_bytes(lists, SLICE_BYTES):
                texts = pieces.decode_slice(*take(lists, np.arange(a, b)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([t.decode() for t in texts], pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Rows of ``DIGESTS``: number and digest of each document's ids, and the
    digest of the text decoded from them. Nulls and repeats as in
    ``encode_documents``; no shuffle."""
    path = vocabulary or vocabulary_path(VOCABULARY)

    def run(batches):
        pieces = codec(path)
        for batch in batches:
            for a, b, ids, ends in pieces.encode(batch.column(1)):
                digests = [hashlib.sha256(t).hexdigest() for t in decimal_lists(ids, ends, pieces.decimals)]
                decoded = [hashlib.sha256(t).hexdigest() for t in pieces.decode_slice(ids, ends)]
                counts = np.diff(np.concatenate([[0], ends]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(counts), pa.array(digests), pa.array(decoded)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, DIGESTS)
