"""Words and shingles of Arrow text columns, a whole batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_TO_SPACE = bytes(32 if b in (9, 10, 11, 12, 13) else b for b in range(256))


def split_words(texts: pa.Array, table: bytes = _TO_SPACE) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word in turn, and each text's last + 1.

    Words are what lies between spaces once ``table`` has translated each byte;
    by default runs of anything but ASCII white space. Texts are not null.
    """
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    spaced = data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes().translate(table) if data else b""
    shifted = pa.py_buffer((offsets - offsets[0]).astype(np.int32).tobytes())
    clean = pa.Array.from_buffers(pa.string(), len(texts), [None, shifted, pa.py_buffer(spaced)])
    split = pc.split_pattern(clean, " ")
    flat = split.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(full)])[split.offsets.to_numpy()[1:]]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), ends


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's ``width``-word shingles.

    A text with fewer words has one shingle, all its words; one without words
    has none.
    """
    words, codes, ends = split_words(texts)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), dtype=np.uint64, count=len(words))
    stream = hashes[codes]
    found, begin = [], 0
    for end in ends.tolist():
        own = stream[begin:end]
        n = min(len(own), width)
        total = np.full(max(len(own) - n + 1, 0) if n else 0, n, dtype=np.uint64)
        for i in range(n):
            total = mix64(total + own[i : i + len(total)])
        found.append(np.unique(total))
        begin = end
    return found
