"""Quality rules from tokeniser fertility.

A public vocabulary with byte fallback encodes each document's words. How many
characters a token holds, how much of the text falls back to bytes and how
evenly the tokens are spread tell prose from codes, keyboard noise and
repetition; what is usual depends on the script, so each script has its bands.
Prose that the vocabulary hardly knows has as few characters per token as random
letters of its script; there the entropy of the tokens decides, alone and given
the token before: tokens of prose are uneven and depend on their neighbours. For
Latin script, where BPE leaves pieces of two letters, letters take their place.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstar.llm.common import slices_by_bytes
from tillstar.llm.tokens import vocabulary_path
from tillstar.llm.words import split_words

VOCABULARY, VOCABULARY_SIZE = "piece_bpe_32k.model", 32_000
#: Ids of the vocabulary that stand for single bytes, first and last.
BYTE_IDS = (3, 258)
#: Base rules: fewest words, and the most percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
SYMBOLS = "[#*$%&|<>]"
#: Text bytes split at once, and words kept between batches.
SLICE_BYTES, KEPT_WORDS = 8 << 20, 300_000

#: Bands by main script: least and most characters per token, most share of
#: byte-fallback tokens, least normalised token entropy. Fixed values; wide
#: enough for any prose, and invented words, in a script. "marked" is Latin text
#: with many letters of MARKED_BLOCKS, such as Vietnamese. Where the vocabulary
#: lacks a script's rare letters, random ones show by bytes: prose and random
#: letters measured 0.07 and 0.56 or more (Devanagari), 0.02 and 0.35 (Thai),
#: 0.13 and 0.44 (Armenian), 0.02 and 0.20 (Georgian).
BANDS = {
    "latin": (1.5, 8.0, 0.10, 0.35),
    "marked": (0.7, 8.0, 0.25, 0.35),
    "cyrillic": (1.1, 7.0, 0.10, 0.35),
    "greek": (0.7, 5.0, 0.25, 0.35),
    "arabic": (0.6, 5.0, 0.25, 0.35),
    "hebrew": (0.6, 5.0, 0.25, 0.35),
    "devanagari": (0.58, 5.0, 0.40, 0.30),
    "thai": (0.6, 5.0, 0.20, 0.30),
    "armenian": (0.68, 5.0, 0.30, 0.30),
    "georgian": (0.7, 5.0, 0.12, 0.30),
    "han": (0.3, 3.0, 0.90, 0.30),
    "kana": (0.4, 3.0, 0.75, 0.30),
    "hangul": (0.3, 3.0, 0.90, 0.30),
    "other": (0.2, 8.0, 1.00, 0.25),
    "none": (1.5, 8.0, 0.10, 0.35),
}
#: First and last code point of the blocks of each script, fixed values.
SCRIPT_BLOCKS = (
    (0x0041, 0x005A, "latin"), (0x0061, 0x007A, "latin"), (0x00C0, 0x024F, "latin"), (0x0370, 0x03FF, "greek"),
    (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x077F, "arabic"),
    (0x0900, 0x097F, "devanagari"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"), (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"), (0x3040, 0x30FF, "kana"), (0x3400, 0x9FFF, "han"),
    (0xAC00, 0xD7AF, "hangul"), (0x20000, 0x3FFFF, "han"),
)
#: Latin letters and marks that are often two tokens or more, and the least
#: share of a text's Latin letters that makes it "marked".
MARKED_BLOCKS, MARKED_SHARE = ((0x0180, 0x02AF), (0x0300, 0x036F), (0x1E00, 0x1EFF)), 0.03
#: Text of fewer characters per token than the first value is kept if its tokens
#: are at most so even, and neighbours at least so dependent. Prose and random
#: letters of 60 to 600 words measured in evenness 0.91 at most and 0.96 at least
#: (Greek, Arabic with Persian, Hebrew), in dependence 1.39 and 1.23 there, 3.6
#: and 1.5 for Cyrillic, whose evenness tells nothing.
DOUBTFUL = {
    "cyrillic": (1.6, 1.0, 2.0),
    "greek": (1.3, 0.94, 1.1),
    "arabic": (1.3, 0.94, 1.1),
    "hebrew": (1.3, 0.94, 1.1),
}
#: The same for the letters of Latin text. Prose of 11 languages and of the test
#: tables measured 0.77 to 0.94 and 1.45 or more; random letters 0.98 or more, or
#: below 1.32, alternating consonants and vowels included.
DOUBTFUL_PER_TOKEN, MOST_EVENNESS, LEAST_DEPENDENCE = 2.5, 0.95, 1.36

MEASURES = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_tokens bigint, chars_per_token double, byte_share double, token_entropy double, script string, "
    "base_failed boolean, kept boolean"
)
_WORD = re.compile(r"[^\x20\x09-\x0D]")
_NAMES = [column.split(" ")[0] for column in MEASURES.split(", ")]


def script_table() -> tuple[np.ndarray, list[str]]:
    """For each code point a script number, and their names; "none" is no letter."""
    names = ["none", "other", *dict.fromkeys(name for _, _, name in SCRIPT_BLOCKS)]
    table = np.zeros(0x110000, dtype=np.uint8)
    letters = [c for c in range(0x20000) if chr(c).isalpha()]
    table[letters] = 1
    for first, last, name in SCRIPT_BLOCKS:
        block = table[first : last + 1]
        block[block > 0 if last < 0x20000 else slice(None)] = names.index(name)
    return table, names


def latin_table() -> np.ndarray:
    """For each code point a number of its Latin letter or mark, case folded; 0 is neither."""
    table = np.zeros(0x110000, dtype=np.uint16)
    blocks = [(first, last) for first, last, name in SCRIPT_BLOCKS if name == "latin"]
    for first, last in (*blocks, *MARKED_BLOCKS):
        for c in range(first, last + 1):
            if chr(c).isalpha() or 0x0300 <= c <= 0x036F:
                lower = ord(chr(c).lower()[0])
                table[c] = lower if lower < 1 << 16 else c
    return table


def letter_pattern(letters: np.ndarray) -> tuple[float, float]:
    """Evenness and dependence of the letters, or tokens, of a text; 0 is none.

    Evenness: their entropy as a share of that of equally frequent letters.
    Dependence: how much likelier two pairs of neighbours are the same than if
    neighbours were independent; 1 for random letters of any frequencies.
    """
    present, codes = np.unique(letters, return_inverse=True)
    codes = codes.reshape(-1).astype(np.int32)
    if len(present) and present[0] == 0:
        codes -= 1
    n = int(codes.max(initial=-1)) + 1
    if n < 2:
        return 1.0, 0.0
    counts = np.bincount(codes[codes >= 0], minlength=n)
    share = counts / counts.sum()
    evenness = float(-(share * np.log(share)).sum() / math.log(n))
    both = (codes[:-1] >= 0) & (codes[1:] >= 0)
    first, second = codes[:-1][both], codes[1:][both]

    def same(values):
        counts = np.unique(values, return_counts=True)[1].astype(float)
        return float((counts * (counts - 1)).sum()) / max(len(values) * (len(values) - 1), 1)

    expected = same(first) * same(second)
    return evenness, same(first.astype(np.int64) * n + second) / expected if expected else 0.0


def repeated_words(codes: np.ndarray) -> int:
    """Words that lie in a window of three words found at least twice."""
    if len(codes) < 4:
        return 0
    _, local = np.unique(codes, return_inverse=True)
    width = int(local.max()) + 1
    if width < 1 << 21:
        windows = (local[:-2] * width + local[1:-1]) * width + local[2:]
        _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    else:
        windows = np.stack([local[:-2], local[1:-1], local[2:]], axis=1)
        _, which, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[which.reshape(-1)] > 1)
    covered = np.zeros(len(codes), dtype=bool)
    for shift in range(3):
        covered[at + shift] = True
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    return len(lines) - len(set(lines))


def normalised_entropy(ids: np.ndarray) -> float:
    """Entropy of the token counts as a share of its greatest value; 0 below two tokens."""
    if len(ids) < 2:
        return 0.0
    _, counts = np.unique(ids, return_counts=True)
    share = counts / len(ids)
    return float(-(share * np.log(share)).sum() / math.log(min(len(ids), VOCABULARY_SIZE)))


class Meter:
    """Measures the texts of an Arrow column; made once per task."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        self.scripts, self.script_names = script_table()
        self.space = self.pieces.piece_to_id("\u2581")
        self.latin = latin_table()
        self.marked = np.zeros(0x110000, dtype=bool)
        for first, last in MARKED_BLOCKS:
            self.marked[first : last + 1] = self.latin[first : last + 1] > 0
        self.words: dict[str, bytes] = {}

    def _ids(self, words: list[str]) -> list[bytes]:
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        new = [w for w in words if w not in self.words]
        for word, ids in zip(new, self.pieces.encode(new, num_threads=1), strict=True):
            self.words[word] = np.array(ids, dtype=np.uint16).tobytes()
        return [self.words[w] for w in words]

    def script(self, points: np.ndarray) -> str:
        counts = np.bincount(self.scripts[points], minlength=len(self.script_names))
        counts[0] = 0
        return self.script_names[int(counts.argmax())] if counts.any() else "none"

    def in_bands(self, points: np.ndarray, tokens: np.ndarray, script: str, per_token: float, in_bytes: float, entropy: float) -> bool:
        """Whether a text of these measures is usual for its script; ``points`` are its code points."""
        if script == "latin":
            letters = self.latin[points]
            if int(self.marked[points].sum()) >= MARKED_SHARE * np.count_nonzero(letters):
                script = "marked"
        least, most, most_bytes, least_entropy = BANDS[script]
        if not (least <= per_token <= most and in_bytes <= most_bytes and entropy >= least_entropy):
            return False
        if script in DOUBTFUL:
            doubtful, most_evenness, least_dependence = DOUBTFUL[script]
            units = tokens[tokens != self.space]
        elif script in ("latin", "marked"):
            doubtful, most_evenness, least_dependence = DOUBTFUL_PER_TOKEN, MOST_EVENNESS, LEAST_DEPENDENCE
            units = letters
        else:
            return True
        if per_token >= doubtful:
            return True
        evenness, dependence = letter_pattern(units)
        return evenness <= most_evenness and dependence >= least_dependence

    def measure(self, doc_ids: list, texts: pa.Array) -> pa.RecordBatch:
        """Rows of ``MEASURES``; texts are not null."""
        words, codes, ends = split_words(texts)
        parts = self._ids(words.to_pylist())
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 2
        ids = np.frombuffer(b"".join(parts), dtype=np.uint16)
        at = np.cumsum(sizes) - sizes
        points = pc.utf8_length(words).to_numpy().astype(np.int64)
        taken = sizes[codes]
        token_ends = np.cumsum(taken)
        tokens = ids[np.repeat(at[codes] - (token_ends - taken), taken) + np.arange(taken.sum())]
        symbols = pc.count_substring_regex(texts, SYMBOLS).to_pylist()
        rows, begin, token_begin = [], 0, 0
        for i, (end, text) in enumerate(zip(ends.tolist(), texts.to_pylist(), strict=True)):
            token_end = int(token_ends[end - 1]) if end else 0
            chars, own = int(points[codes[begin:end]].sum()), tokens[token_begin:token_end]
            n = len(own)
            in_bytes = int(((own >= BYTE_IDS[0]) & (own <= BYTE_IDS[1])).sum())
            code_points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            repeated, script = repeated_words(codes[begin:end]), self.script(code_points)
            per_token, in_bytes, entropy = chars / n if n else 0.0, in_bytes / n if n else 0.0, normalised_entropy(own)
            failed = end - begin < LEAST_WORDS or 100 * repeated > MOST_REPEATED_PERCENT * (end - begin)
            kept = not failed and self.in_bands(code_points, own, script, per_token, in_bytes, entropy)
            rows.append(
                (
                    doc_ids[i], end - begin, chars, symbols[i], duplicate_lines(text), repeated, n,
                    per_token, in_bytes, entropy, script, failed, kept,
                )
            )
            begin, token_begin = end, token_end
        kinds = [pa.int64()] * 7 + [pa.float64()] * 3 + [pa.string()] + [pa.bool_()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)


def _measured(batches, path: str, names: list[str]):
    """(slice of a batch, its measures) for every slice; ``names`` are the batch's columns."""
    meter = Meter(path)
    text, doc_id = names.index("text"), names.index("doc_id")
    for batch in batches:
        texts = batch.column(text).fill_null("")
        for a, b in slices_by_bytes(texts, SLICE_BYTES):
            part = batch.slice(a, b - a)
            yield part, meter.measure(part.column(doc_id).to_pylist(), texts.slice(a, b - a))


def judge(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row of ``MEASURES`` per document; no shuffle.

    ``base_failed``: fewer than 50 words, or more than half of the words in
    repeated three-word windows. ``kept``: not failed, within the bands, and not a
    text whose tokens (Latin script: letters) look random where characters per
    token leave it open.

    Null, empty and blank texts have no words and fail. Documents without a
    letter are judged by the bands named "none". Rows are judged one by one,
    so repeated rows and null ids come out as they went in; an empty table
    gives no rows; further columns are ignored.
    """
    path = vocabulary or vocabulary_path(VOCABULARY)

    def run(batches):
        for _, measures in _measured(batches, path, ["doc_id", "text"]):
            yield measures

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, MEASURES)


def kept_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns; no join."""
    path, names = vocabulary or vocabulary_path(VOCABULARY), docs.columns

    def run(batches):
        for part, measures in _measured(batches, path, names):
            yield part.filter(measures.column("kept"))

    return docs.mapInArrow(run, docs.schema)
