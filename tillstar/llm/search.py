"""Ranked lexical search by accumulator-limited term-at-a-time evaluation.

Documents are cut into terms once; of each document the terms of the queries
stay, as postings in the shared folder. Counts over all documents give the
weights. Then every task walks its own documents: for a query the rarest term
comes first, each posting adds to the accumulator of its document, and once
what the remaining terms can add at most is below the k-th best partial score,
no accumulator is made any more; those that exist are updated to the end, so
the scores of the best are exact. A task's best rows go to a final ranking.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillstar.llm.common import slices_by_bytes
from tillstar.llm.words import split_words
from tillstar.session import discard, settle

#: Documents returned for each query.
BEST = 10
#: Text bytes cut into terms at once, and groups that a query's best rows are ranked in first.
SLICE_BYTES, FIRST_GROUPS = 8 << 20, 32
#: Queries of one pass over the documents: at most so many, and so many terms.
BLOCK_QUERIES, BLOCK_TERMS = 4096, 200_000

#: ASCII letters and digits stay, upper case becomes lower case, other ASCII
#: characters separate; bytes of further characters stay.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

RANKED = "item_id bigint, rank int, doc_id bigint, score bigint"


@dataclass
class Queries:
    """A block of queries: the id of each and its distinct terms, by number."""

    ids: list[int | None]
    terms: list[str]
    wanted: list[np.ndarray]


def distinct_terms(text: str) -> list[str]:
    """The distinct terms of one text in code point order."""
    return sorted(set(text.encode().translate(_TERMS).decode().split(" ")) - {""})


def query_blocks(rows: Iterable[tuple[int | None, str | None]], most: int = BLOCK_QUERIES, most_terms: int = BLOCK_TERMS) -> Iterator[Queries]:
    """Queries in blocks of bounded size; a single query may have any number of terms."""
    ids, numbers, wanted = [], {}, []
    for item_id, text in rows:
        own = distinct_terms(text or "")
        if ids and (len(ids) >= most or len(numbers) + len(own) > most_terms):
            yield Queries(ids, list(numbers), wanted)
            ids, numbers, wanted = [], {}, []
        ids.append(item_id)
        wanted.append(np.array([numbers.setdefault(t, len(numbers)) for t in own], dtype=np.int64))
    if ids:
        yield Queries(ids, list(numbers), wanted)


def postings(docs: DataFrame, terms: Sequence[str]) -> DataFrame:
    """doc_id, n (all terms with repeats), and the numbers and counts of those in ``terms``."""
    listed = pa.array(terms, pa.string())

    def run(batches):
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for a, b in slices_by_bytes(texts, SLICE_BYTES):
                words, codes, ends = split_words(texts.slice(a, b - a), _TERMS)
                sizes = np.diff(np.concatenate([[0], ends]))
                number = pc.index_in(words, value_set=listed).fill_null(-1).to_numpy().astype(np.int64)[codes]
                of_document = np.repeat(np.arange(b - a), sizes)
                known = number >= 0
                pairs, counts = np.unique((of_document[known] << 32) | number[known], return_counts=True)
                upto = np.searchsorted(pairs, np.arange(1, b - a) << 32)
                lists = [[x.tobytes() for x in np.split(v.astype("<u4"), upto)] for v in (pairs & 0xFFFFFFFF, counts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes), *[pa.array(x, pa.binary()) for x in lists]], ["doc_id", "n", "terms", "counts"]
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n bigint, terms binary, counts binary")


def document_frequencies(posted: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term of the block; one row per term reaches the driver."""

    def run(batches):
        held = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            data = b"".join(batch.column(0).to_pylist())
            held += np.bincount(np.frombuffer(data, "<u4"), minlength=n_terms)
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(held[seen])], ["term", "df"])

    summed = posted.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    frequencies = np.zeros(n_terms, dtype=np.int64)
    for term, df in summed.collect():
        frequencies[term] = df
    return frequencies


def term_weights(frequencies: np.ndarray, n_documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1))) for df in frequencies.tolist()], dtype=np.int64)


class Shard:
    """The postings of some documents by term, with what each adds to a score."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray, n_documents: int, length: int):
        n = batch.column("n").to_pylist()
        damping = np.array([10 + 90 * x * n_documents // length for x in n], dtype=np.int64)
        terms = np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<u4").astype(np.int64)
        counts = np.frombuffer(b"".join(batch.column("counts").to_pylist()), "<u4").astype(np.int64)
        sizes = pc.binary_length(batch.column("terms")).to_numpy().astype(np.int64) // 4
        document = np.repeat(np.arange(len(n)), sizes)
        parts = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * damping[document]))
        order = np.argsort(terms, kind="stable")
        self.documents, self.parts, self.size = document[order], parts[order], len(n)
        self.borders = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        held = np.flatnonzero(np.diff(self.borders))
        self.bounds = np.zeros(len(weights), dtype=np.int64)
        if len(held):
            self.bounds[held] = np.maximum.reduceat(self.parts, self.borders[held])

    def scores(self, terms: np.ndarray, floor: int, k: int = BEST) -> tuple[np.ndarray, int]:
        """(accumulators, terms after which none was made any more).

        ``terms`` come rarest first. The score of every document that can be
        among the best ``k`` here, and exceeds or equals ``floor``, is exact;
        others may lack some terms.
        """
        total = np.zeros(self.size, dtype=np.int64)
        remaining = np.cumsum(self.bounds[terms][::-1])[::-1].tolist()
        closed = None
        for i, term in enumerate(terms.tolist()):
            a, b = self.borders[term], self.borders[term + 1]
            if closed is None and remaining[i] < max(floor, remaining[0] - remaining[i]):
                kth = int(np.partition(total, -k)[-k]) if self.size >= k else 0
                if remaining[i] < max(floor, kth):
                    closed = i
            documents, parts = self.documents[a:b], self.parts[a:b]
            if closed is not None:
                live = total[documents] > 0
                documents, parts = documents[live], parts[live]
            total[documents] += parts
        return total, len(terms) if closed is None else closed


def _keep_best(best: tuple[np.ndarray, ...], found: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The k best of two lists of (score, null id, id), equal scores by id, null last."""
    score, unknown, ids = (np.concatenate([x, y]) for x, y in zip(best, found, strict=True))
    order = np.lexsort((ids, unknown, -score))[:k]
    return score[order], unknown[order], ids[order]


def best_of_tasks(posted: DataFrame, queries: Queries, frequencies: np.ndarray, n_documents: int, length: int, k: int = BEST) -> DataFrame:
    """item (number in the block), doc_id, score: each task's best ``k`` rows of every query."""
    weights = term_weights(frequencies, n_documents)
    # ties by number, so that every task walks the terms in one order
    wanted = [t[np.lexsort((t, frequencies[t]))] for t in queries.wanted]

    def run(batches):
        empty = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)
        best = [empty] * len(wanted)
        for batch in batches:
            shard = Shard(batch, weights, n_documents, length)
            unknown = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            for item, terms in enumerate(wanted):
                scores = best[item][0]
                floor = int(scores[-1]) if len(scores) == k else 0
                total, _ = shard.scores(terms, floor, k)
                least = max(floor, int(np.partition(total, -k)[-k]) if shard.size >= k else 0, 1)
                at = np.flatnonzero(total >= least)
                if len(at):
                    best[item] = _keep_best(best[item], (total[at], unknown[at], ids[at]), k)
        items = np.repeat(np.arange(len(best)), [len(s) for s, _, _ in best])
        score, unknown, ids = (np.concatenate([empty[i], *[b[i] for b in best]]) for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(ids, mask=unknown), pa.array(score)], ["item", "doc_id", "score"])

    return posted.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def search_block(docs: DataFrame, queries: Queries, k: int = BEST) -> DataFrame:
    """Rows of ``RANKED`` for one block of queries."""
    spark = docs.sparkSession
    posted = settle(postings(docs, queries.terms), "postings")
    n_documents, length = posted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not length or not queries.terms:
        return spark.createDataFrame([], RANKED)
    frequencies = document_frequencies(posted, len(queries.terms))
    found = best_of_tasks(posted, queries, frequencies, n_documents, length, k)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # many tasks' rows of a query are first ranked in groups
    grouped = found.withColumn("group", F.pmod(F.xxhash64("doc_id", "score"), F.lit(FIRST_GROUPS)))
    first = grouped.withColumn("rank", F.row_number().over(Window.partitionBy("item", "group").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    ids = spark.createDataFrame(list(enumerate(queries.ids)), "item bigint, item_id bigint")
    result = settle(ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
    discard(posted)
    return result


def search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """Rows of ``RANKED``: the ``k`` highest-scoring documents of each item.

    Terms are runs of ASCII letters, ASCII digits and any further characters,
    A to Z in lower case. Only scores above 0 count; equal scores are ranked by
    ascending doc_id, null last.

    Null, empty and blank texts have no term: such items get no rows, such
    documents count nowhere. Rows that repeat a doc_id are documents of their
    own, rows that repeat an item_id queries of their own, with rows each. An
    empty table gives no rows. Further columns are ignored. Items are read in
    blocks of bounded size, each of which passes over the documents once.
    """
    rows = ((r[0], r[1]) for r in items.select(F.col("item_id").cast("bigint"), "text").toLocalIterator())
    found = [search_block(docs, block, k) for block in query_blocks(rows)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], RANKED)
