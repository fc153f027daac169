"""Token ids of whole texts with the public byte-pair vocabularies.

The vocabularies never merge across the start of a word, so a text's ids are
those of its words in turn. A slice of texts is split at spaces, and distinct
pieces of letters, marks and line breaks are cut into words by their bytes and
merged by the agenda, all at once. Pieces with anything else go through the
``tokenizers`` library, and so do, as a whole, texts for which the split would
not be exact. Nothing is kept between slices, so memory is bounded.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tillstar.llm.agenda import Merges, merge_words
from tillstar.llm.common import slices_by_bytes

#: Bytes of text split at once.
SLICE_BYTES = 8 << 20

#: Classes of bytes: anything else, letter, digit, mark, line break, space before a piece.
OTHER, LETTER, DIGIT, MARK, BREAK, SPACE = range(6)
#: ASCII marks; an apostrophe may start a word of its own and is none.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
_CLASS[[*range(48, 58)]] = DIGIT
_CLASS[[ord(c) for c in MARKS]] = MARK
_CLASS[10] = BREAK


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


def ragged(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Lists of 16-bit ids, up to ``ends``, as binary values."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * 2
    data = np.ascontiguousarray(values, dtype="<u2")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def take(lists: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the lists numbered by ``codes``, one after the other, and each one's end."""
    found = lists.take(pa.array(codes))
    ends = np.frombuffer(found.buffers()[1], dtype=np.int64)[1 : len(codes) + 1] // 2
    data = found.buffers()[2]
    return np.frombuffer(data, dtype="<u2")[: ends[-1] if len(ends) else 0] if data else np.zeros(0, "<u2"), ends


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column without nulls, and each value's end."""
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column), dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


class Encoder:
    """Ids of the texts of an Arrow column; made once per worker process.

    ``plain`` takes the strings of added tokens for ordinary text.
    """

    #: whether the space before a word is part of its token
    spaced: bool

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        self.added = [] if plain else [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.letters = dict(enumerate(byte_letters()))
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.vocabulary, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = (np.array([self.vocabulary[p[i]] for p in pairs], dtype=np.int64) for i in (0, 1))
        merged = np.array([self.vocabulary["".join(p)] for p in pairs], dtype=np.int64)
        self.merges = Merges(left, right, np.arange(len(pairs)), merged)
        self.inner = np.array([self.vocabulary[c] for c in byte_letters()], dtype=np.int32)
        self.last = np.array([self.vocabulary[c + self.suffix] for c in byte_letters()], dtype=np.int32)

    def whole(self, texts: list[str]) -> pa.Array:
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        ends = np.cumsum([len(ids) for ids in found], dtype=np.int64)
        return ragged(np.array([i for ids in found for i in ids], dtype="<u2"), ends)

    def _irregular(self, texts: pa.Array) -> np.ndarray:
        """Which texts hold an added token, which the library finds before anything else."""
        found = np.zeros(len(texts), dtype=bool)
        for content in self.added:
            found |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        return found

    def _folded(self, data: np.ndarray, after_c3: np.ndarray) -> np.ndarray:
        return data

    def _pieces(self, pieces: pa.Array) -> pa.Array:
        """Ids of each piece of text between two spaces; where the space is part
        of the token, a piece comes with it."""
        data, ends = bytes_of(pieces)
        starts = np.concatenate([[0], ends[:-1]])
        after_c3 = np.concatenate([[False], data[:-1] == 0xC3]) if len(data) else np.zeros(0, dtype=bool)
        data = self._folded(data, after_c3)
        kind = _CLASS[data]
        kind[after_c3 & (data != 0x97) & (data != 0xB7)] = LETTER
        kind[data == 0xC3] = LETTER
        begins = np.zeros(len(data) + 1, dtype=bool)
        begins[starts] = True
        begins = begins[:-1]
        kind[begins & (data == 32)] = SPACE
        before = np.concatenate([[OTHER], kind[:-1]]) if len(kind) else kind
        odd = kind == OTHER
        if self.spaced:  # white space that runs together
            odd |= (kind == BREAK) & (begins | (before == BREAK) | (before == SPACE))
            closes = np.zeros(len(data) + 1, dtype=bool)
            closes[ends] = True
            odd |= (kind == SPACE) & closes[1:]
        upto = np.concatenate([[0], np.cumsum(odd)])
        irregular = upto[ends] > upto[starts]

        run = begins | ((kind != before) & (before != SPACE)) | (kind == BREAK)
        if not self.spaced:  # where words are single digits
            run |= kind == DIGIT
        run_starts = np.flatnonzero(run)
        of_piece = np.searchsorted(ends, run_starts, side="right")
        wanted = ~irregular[of_piece]
        if not self.spaced:
            wanted &= kind[run_starts] != BREAK
        offsets = np.append(run_starts, len(data)).astype(np.int64)
        runs = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(run_starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
        )
        coded = runs.filter(pa.array(wanted)).dictionary_encode()
        words, codes = self._words(coded.dictionary), coded.indices.to_numpy()
        ids, run_ends = take(words, codes)
        run_counts = np.bincount(of_piece[wanted], minlength=len(pieces))
        found = ragged(ids, np.concatenate([[0], run_ends])[np.cumsum(run_counts)])
        rest = np.flatnonzero(irregular)
        if len(rest):
            found = pa.concat_arrays([found, self.whole(pieces.take(pa.array(rest)).to_pylist())])
            at = np.arange(len(pieces))
            at[rest] = len(pieces) + np.arange(len(rest))
            found = found.take(pa.array(at))
        return found

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words, merged by the agenda."""
        data, ends = bytes_of(words)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        return ragged(*merge_words(symbols, ends, self.merges))

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in turn, as 16-bit integers; null is empty."""
        texts = texts.fill_null("")
        for start, end in slices_by_bytes(texts, SLICE_BYTES):
            ids, ends = self.encode_slice(texts.slice(start, end - start))
            yield from np.split(ids, ends[:-1])

    def encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and each text's end; no nulls."""
        odd = self._irregular(texts)
        if not odd.any():
            return self._gather(texts)
        plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
        lists = [self.whole(texts.take(pa.array(rest)).to_pylist())]
        if len(plain):
            lists.append(ragged(*self._gather(texts.take(pa.array(plain)))))
        at = np.empty(len(texts), dtype=np.int64)
        at[np.concatenate([rest, plain])] = np.arange(len(texts))
        return take(pa.concat_arrays(lists), at)

    def _gather(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.split_pattern(texts, " ")
        starts = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        pieces = split.flatten()
        coded = pieces.dictionary_encode()
        distinct, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        if self.spaced:
            # a text's first piece has no space before it
            firsts = pieces.take(pa.array(starts))
            codes[starts] = len(distinct) + np.arange(len(starts))
            distinct = pa.concat_arrays([pc.binary_join_element_wise("", distinct, " "), firsts])
        ids, ends = take(self._pieces(distinct), codes)
        return ids, ends[np.append(starts[1:], len(codes)) - 1]


class ByteEncoder(Encoder):
    """Byte-level vocabulary whose tokens hold the space before a word."""

    spaced = True

    def _irregular(self, texts):
        return super()._irregular(texts) | pc.match_substring(texts, "  ").to_numpy(zero_copy_only=False)


class WordEncoder(Encoder):
    """Lower-case vocabulary with word ends; white space is dropped."""

    spaced = False

    def _folded(self, data, after_c3):
        upper = ((data >= 65) & (data <= 90)) | (after_c3 & (data >= 0x80) & (data <= 0x9E) & (data != 0x97))
        return data + (upper * np.uint8(32))


_made: dict[tuple, Encoder] = {}


def encoder(kind: type[Encoder], path: str, plain: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if (kind, path, plain) not in _made:
        _made[kind, path, plain] = kind(path, plain)
    return _made[kind, path, plain]
