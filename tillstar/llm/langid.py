"""Language identification by multilingual mixture inference.

A model holds, per language, the log-probabilities of hashed character
trigrams, counted over all labelled documents. A document is a mixture: each
of its words comes from one of a set of languages. Expectation-maximisation
finds the proportions from the words' trigram likelihoods; languages join the
set, best first, while the log-likelihood gains more than a penalty.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstar.llm.common import rows_of

#: Hash buckets of trigrams, and what is added to every count.
BUCKETS, SMOOTHING = 1 << 15, 0.5
#: EM steps at most and the change of the proportions at which it stops.
STEPS, CONVERGED = 30, 1e-4
#: Penalty for each further language, in units of log(words); its least share of a document.
PENALTY, LEAST_SHARE = 2.0, 0.02
#: Words of a document whose likelihoods are held at once.
WORDS_AT_ONCE = 50_000
UNDETERMINED = "und"
#: A pipeline keeps documents whose main language has at least this share.
LEAST_SCORE = 0.5

PREDICTIONS = "doc_id bigint, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>"
_PREDICTIONS_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()),
        ("languages", pa.list_(pa.string())), ("shares", pa.list_(pa.float64())),
    ]
)


def held_out(doc_id: Column) -> Column:
    """Whether a document takes no part in learning; a null id does not either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    table = np.zeros(0x110000, dtype=bool)
    table[[c for c in range(0x40000) if chr(c).isalpha()]] = True
    return table


def trigrams(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of each word, with its edges, and each word's first.

    Words are maximal runs of letters in lower case.
    """
    points = np.frombuffer((" " + text.lower() + "  ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters[points]
    # one blank after each word is enough
    keep = is_letter | np.concatenate([[True], is_letter[:-1]])
    points, is_letter = np.where(is_letter, points, 32)[keep].astype(np.uint64), is_letter[keep]
    if not is_letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = (points[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (points[2:] * np.uint64(0x165667B19E3779F9))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    buckets = (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    # a trigram belongs to the word of its middle letter
    middle = is_letter[1:-1]
    first = middle & ~is_letter[:-2]
    return buckets[middle], np.flatnonzero(first[middle])


def count_trigrams(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over all documents that are not held out and have a lang."""

    def run(batches):
        letters = letter_table()
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in rows_of([batch]):
                buckets, _ = trigrams(text, letters)
                if lang not in counts:
                    counts[lang] = np.zeros(BUCKETS, dtype=np.int64)
                seen, n = np.unique(buckets, return_counts=True)
                counts[lang][seen] += n
        for lang, n in counts.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(n[seen])], ["lang", "bucket", "n"])

    labelled = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return labelled.select("text", "lang").mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities of trigram buckets per language."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(lang for lang, n in counts.items() if n.any())
        table = np.zeros((BUCKETS, len(self.languages)), dtype=np.float32)
        for i, lang in enumerate(self.languages):
            n = counts[lang] + SMOOTHING
            table[:, i] = np.log(n / n.sum())
        self.table = table

    def word_scores(self, text: str, letters: np.ndarray) -> np.ndarray:
        """Log-likelihood of each word (rows) in each language (columns)."""
        buckets, starts = trigrams(text, letters)
        parts = []
        for a in range(0, len(starts), WORDS_AT_ONCE):
            own = starts[a : a + WORDS_AT_ONCE]
            end = starts[a + WORDS_AT_ONCE] if a + WORDS_AT_ONCE < len(starts) else len(buckets)
            parts.append(np.add.reduceat(self.table[buckets[own[0] : end]], own - own[0], axis=0))
        return np.concatenate(parts).astype(np.float64) if parts else np.zeros((0, len(self.languages)))


def proportions(scores: np.ndarray) -> tuple[np.ndarray, float]:
    """Maximum-likelihood proportions of the columns and the log-likelihood."""
    peak = scores.max(axis=1, keepdims=True)
    likelihood = np.exp(scores - peak)
    share = np.full(scores.shape[1], 1 / scores.shape[1])
    for _ in range(STEPS):
        joint = likelihood * share
        new = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
        change, share = np.abs(new - share).max(), new
        if change < CONVERGED:
            break
    return share, float((np.log(np.maximum((likelihood * share).sum(axis=1), 1e-300)) + peak[:, 0]).sum())


def choose_languages(scores: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The language set of the greatest penalised likelihood found by adding
    the best language at a time, and its proportions, largest first."""
    totals = scores.sum(axis=0)
    chosen, share, value = [int(totals.argmax())], np.ones(1), float(totals.max())
    penalty = PENALTY * math.log(len(scores) + 1)
    while len(chosen) < scores.shape[1]:
        # the candidate that explains best the words the chosen ones explain badly
        covered = scores[:, chosen].max(axis=1, keepdims=True)
        gain = np.maximum(scores - covered, 0).sum(axis=0)
        gain[chosen] = -1
        candidate = [*chosen, int(gain.argmax())]
        if gain[candidate[-1]] <= penalty:
            break
        new_share, new_value = proportions(scores[:, candidate])
        if new_value - value <= penalty or new_share[-1] < LEAST_SHARE:
            break
        chosen, share, value = candidate, new_share, new_value
    order = np.argsort(-share, kind="stable")
    return [chosen[i] for i in order], share[order]


def fit(docs: DataFrame) -> Model:
    """Learn from all documents that are not held out. The driver holds a
    table of ``BUCKETS`` numbers per language, whatever the input."""
    counts: dict[str, np.ndarray] = {}
    for lang, bucket, n in count_trigrams(docs).toLocalIterator():
        counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))[bucket] = n
    return Model(counts)


def _identify(texts: list[str | None], model: Model, letters: np.ndarray) -> list[tuple[str, float, list[str], list[float]]]:
    found = []
    for text in texts:
        scores = model.word_scores(text or "", letters)
        if not len(scores) or not model.languages:
            found.append((UNDETERMINED, 0.0, [], []))
            continue
        chosen, share = choose_languages(scores)
        names = [model.languages[i] for i in chosen]
        found.append((names[0], min(max(float(share[0]), 0.0), 1.0), names, share.tolist()))
    return found


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row of ``PREDICTIONS`` per document.

    ``score`` is the share of the main language; ``languages`` and ``shares``
    list the chosen set. Only the text decides.

    Null texts and texts without a letter are ``und`` with score 0, and so is
    everything if nothing could be learned. Null ids count as held out.
    Repeated rows are judged one by one; an empty table gives no rows; further
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        letters = letter_table()
        for batch in batches:
            ids, outside, texts = batch.columns
            found = _identify(texts.to_pylist(), shared.value, letters)
            columns = [ids, outside, *[pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), list(_PREDICTIONS_ARROW)[2:], strict=True)]]
            if len(ids):
                yield pa.RecordBatch.from_arrays(columns, schema=_PREDICTIONS_ARROW)

    rows = docs.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, PREDICTIONS)


def kept_documents(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` with a main language of at least ``least``; no join."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches):
        letters = letter_table()
        for batch in batches:
            found = _identify(batch.column(names.index("text")).to_pylist(), shared.value, letters)
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score, _, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
