"""Similarity join of word shingle sets with a MinHash LSH forest.

Each distinct shingle set gets a MinHash signature, cut into labels for a
number of trees. A tree is its labels in sorted order: a prefix trie in which
neighbours share a prefix, and every set that shares the first k hashes of a
label lies in one unbroken run. One sort therefore serves all prefix lengths.
The matched prefix is shortened, one hash at a time, until the recall expected
for the similar pairs seen in the corpus reaches the target. Sets that share a
prefix are compared by sketches, four bits of each hash; what hangs together by
sketches that agree is a block, and all pairs of a block are verified on the
exact shingle sets.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillstar.llm.common import map_sorted_groups, slices_by_bytes, whole_row
from tillstar.llm.links import LINKS, components, deal, link_summary, pair_up
from tillstar.llm.words import mix64, shingle_sets
from tillstar.session import discard, settle

WORDS, THRESHOLD = 5, Fraction(4, 5)
#: Trees, hashes of a label, the shortest prefix matched, and the recall to be expected.
TREES, DEPTH, SHORTEST, TARGET_RECALL = 24, 6, 3, 0.99999
SEED = 20_240_617
#: Bits of each hash that a sketch keeps, and the least share of them to agree.
#: At the threshold 0.8125 agree on average, with a deviation of 0.033: a linked
#: pair stays below with a chance of 1e-8, one of similarity 0.3 is above with 1e-11.
SKETCH_BITS, SKETCH_AGREES = 4, 0.625
#: Rows of a run compared at once.
RUN_ROWS = 2048
#: Rows and shingles of one chunk of a block, and text bytes hashed at once.
CHUNK_ROWS, CHUNK_SHINGLES, SLICE_BYTES = 2048, 1 << 19, 8 << 20
#: Columns of the incidence matrix multiplied at once.
COLUMNS = 4096


def hash_family(seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    numbers = mix64(np.arange(1, 2 * TREES * DEPTH + 1, dtype=np.uint64) + np.uint64(seed))
    return numbers[0::2] | np.uint64(1), numbers[1::2]


def signature(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Smallest value of each hash function over the shingles, 32 bits each."""
    factor, shift = family
    least = np.full(len(factor), np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(shingles), 512):
        values = factor[:, None] * shingles[None, a : a + 512]
        values += shift[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(">u4")


def sketch(signature: np.ndarray) -> bytes:
    """The lowest ``SKETCH_BITS`` bits of each hash, two hashes a byte."""
    low = (signature & ((1 << SKETCH_BITS) - 1)).astype(np.uint8)
    return (low[0::2] << SKETCH_BITS | low[1::2]).tobytes()


def agreement(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Share of hashes whose bits agree, for rows of sketches."""
    both = first ^ second
    low = (1 << SKETCH_BITS) - 1
    equal = (both & low == 0).sum(axis=1) + (both >> SKETCH_BITS == 0).sum(axis=1)
    return equal / (2 * first.shape[1])


def sketches(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def sign_documents(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), key, n_shingles, signature and sketch of
    each document; nulls where there is no word."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("mark", pa.int64()), ("key", pa.binary()), ("n_shingles", pa.int64()),
            ("signature", pa.binary()), ("sketch", pa.binary()),
        ]
    )

    def run(batches):
        family = hash_family()
        for batch in batches:
            texts = batch.column(2).fill_null("")
            for a, b in slices_by_bytes(texts, SLICE_BYTES):
                sets = shingle_sets(texts.slice(a, b - a), WORDS)
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                signatures = [signature(s, family) if len(s) else None for s in sets]
                sizes = pa.array([len(s) for s in sets], pa.int64())
                known = [c.slice(a, b - a) for c in batch.columns[:2]]
                coded = [None if s is None else s.tobytes() for s in signatures], [None if s is None else sketch(s) for s in signatures]
                yield pa.RecordBatch.from_arrays([*known, pa.array(keys, pa.binary()), sizes, *[pa.array(c, pa.binary()) for c in coded]], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("mark"), "text").mapInArrow(
        run, "doc_id bigint, mark bigint, key binary, n_shingles bigint, signature binary, sketch binary"
    )


def trie_neighbours(classes: DataFrame) -> DataFrame:
    """u, v, shared, estimate, tree, label: neighbours in the sorted labels of each tree.

    ``shared`` is the number of leading hashes they have in common, at least
    ``SHORTEST``; ``estimate``, for the first tree only, the similarity that
    their sketches tell; ``label`` that of ``u``. Runs that cross the border of two partitions
    are joined by the last label of the one and the first of the next.
    """
    width = 4 * DEPTH
    labels = (
        classes.select("id", "signature", "sketch", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
        .withColumn("label", F.expr(f"substring(signature, tree * {width} + 1, {width})"))
        .select("tree", "label", "id", F.when(F.col("tree") == 0, F.col("sketch")).alias("sketch"))
    )
    in_order = labels.repartitionByRange("tree", "label", "id").sortWithinPartitions("tree", "label", "id")
    names = ["u", "v", "shared", "estimate", "tree", "label", "last"]

    chance = 1 / (1 << SKETCH_BITS)

    def neighbours(trees, ids, labels, coded):
        matrix = np.frombuffer(b"".join(labels), ">u4").reshape(len(labels), DEPTH)
        same = matrix[1:] == matrix[:-1]
        shared = np.cumprod(same, axis=1).sum(axis=1) * (trees[1:] == trees[:-1])
        at = np.flatnonzero(shared >= SHORTEST)
        first = at[trees[at] == 0]
        estimates = np.full(len(at), np.nan)
        if len(first):
            agree = agreement(sketches([coded[i] for i in first.tolist()]), sketches([coded[i + 1] for i in first.tolist()]))
            estimates[trees[at] == 0] = (agree - chance) / (1 - chance)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[at]), pa.array(ids[at + 1]), pa.array(shared[at], pa.int32()), pa.array(estimates, from_pandas=True),
                pa.array(trees[at], pa.int32()), pa.array([labels[i] for i in at.tolist()], pa.binary()), pa.nulls(len(at), pa.bool_()),
            ], names
        )

    def border(tree, label, i, last):
        values = [i, None, None, None, tree, label, last]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    def run(batches):
        held = None
        for batch in batches:
            if not len(batch):
                continue
            trees, ids = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            labels, coded = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            if held is None:
                yield border(int(trees[0]), labels[0], int(ids[0]), False)
            else:
                trees, ids = np.concatenate([held[0], trees]), np.concatenate([held[1], ids])
                labels, coded = held[2] + labels, held[3] + coded
            yield neighbours(trees, ids, labels, coded)
            held = trees[-1:], ids[-1:], labels[-1:], coded[-1:]
        if held is not None:
            yield border(int(held[0][0]), held[2][0], int(held[1][0]), True)

    schema = "u bigint, v bigint, shared int, estimate double, tree int, label binary, last boolean"
    return in_order.mapInArrow(run, schema)


def stitched(neighbours: DataFrame) -> DataFrame:
    """u, v, shared, tree, label for runs that go on in the next partition; two rows per
    partition reach the driver."""
    borders = sorted(
        (r.tree, bytes(r.label), r.u, r.last) for r in neighbours.filter("last is not null").select("tree", "label", "u", "last").collect()
    )
    found = []
    for (tree, label, u, last), (next_tree, next_label, v, next_last) in zip(borders, borders[1:], strict=False):
        if tree == next_tree and u != v:
            shared = next((i for i in range(DEPTH) if label[4 * i : 4 * i + 4] != next_label[4 * i : 4 * i + 4]), DEPTH)
            if shared >= SHORTEST:
                found.append((u, v, shared, tree, label))
    return neighbours.sparkSession.createDataFrame(found, "u bigint, v bigint, shared int, tree int, label binary")


def recall(similarity, prefix: int):
    """Chance that two sets of a similarity share a prefix in at least one tree."""
    return 1 - (1 - similarity**prefix) ** TREES


def matched_prefix(neighbours: DataFrame, target: float = TARGET_RECALL) -> int:
    """The longest prefix whose expected recall reaches the target.

    The expectation is over neighbours in the first tree that look similar
    enough, as a sample of all similar pairs; one with similarity s is there
    with a chance of about s ** SHORTEST and counts accordingly. Without any,
    all pairs are taken to be at the threshold.
    """
    similar = neighbours.filter(F.col("estimate") >= float(THRESHOLD))
    weight = 1 / F.pow("estimate", F.lit(SHORTEST))
    sums = similar.agg(
        F.sum(weight).alias("all"),
        *[
            F.sum(weight * (1 - F.pow(1 - F.pow("estimate", F.lit(k)), F.lit(TREES)))).alias(f"k{k}")
            for k in range(SHORTEST, DEPTH + 1)
        ],
    ).first()
    prefix = DEPTH
    while prefix > SHORTEST:
        expected = sums[f"k{prefix}"] / sums["all"] if sums["all"] else recall(float(THRESHOLD), prefix)
        if expected >= target:
            break
        prefix -= 1
    return prefix


def unite(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Give the positions of each pair the same ``root``, the lowest position they reach."""
    while True:
        a, b = root[left], root[right]
        apart = a != b
        if not apart.any():
            return
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, root[root]):
            root[:] = root[root]


def alike(group: np.ndarray, own: np.ndarray, split: np.ndarray, coded: np.ndarray) -> np.ndarray:
    """For each row the position of a row it hangs together with, by sketches.

    Rows of a group stand side by side; ``split`` tells that the group compares
    two chunks, so that only rows of different ``own`` meet. All rows are
    compared with the one a step further, then two steps, until groups end;
    those already together are passed over.
    """
    root = np.arange(len(group))
    at, step = root, 1
    while True:
        at = at[at + step < len(group)]
        at = at[group[at + step] == group[at]]
        if not len(at):
            return root
        meet = at[(root[at] != root[at + step]) & (~split[at] | (own[at] != own[at + step]))]
        for a in range(0, len(meet), 1 << 16):
            some = meet[a : a + (1 << 16)]
            some = some[agreement(coded[some], coded[some + step]) >= SKETCH_AGREES]
            unite(root, some, some + step)
        step += 1


def candidate_edges(classes: DataFrame, pairs: DataFrame, prefix: int) -> DataFrame:
    """u, v: sets that hang together within a run, a run being the sets that
    share the first ``prefix`` hashes of a label.

    Long runs are dealt into chunks and compared chunk by chunk. A run reports
    one row per set, not its pairs.
    """
    run = F.xxhash64("tree", F.substring("label", 1, 4 * prefix)).alias("run")
    near = pairs.filter(F.col("shared") >= prefix)
    members = near.select(run, F.explode(F.array("u", "v")).alias("id")).distinct()
    dealt = pair_up(deal(members.withColumn("_one", F.lit(1)), ["run"], "id", "_one", RUN_ROWS, RUN_ROWS).drop("_one"))
    rows = dealt.join(classes.select("id", "sketch"), "id").select("run", "a", "b", "own", "id", "sketch")
    keys = ["run", "a", "b"]

    def compare(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            group = group_of(table)
            # the last group may go on in the next batch
            end = int(np.searchsorted(group, group[-1])) if len(group) else 0
            if end:
                yield edges_of(table.slice(0, end), group[:end])
            held = table.slice(end)
        if held is not None and len(held):
            yield edges_of(held, group_of(held))

    def group_of(table):
        change = np.zeros(len(table), dtype=bool)
        for name in keys:
            values = table.column(name).to_numpy()
            change[1:] |= values[1:] != values[:-1]
        return np.cumsum(change)

    def edges_of(table, group):
        a, b, own, ids = (table.column(name).to_numpy() for name in ("a", "b", "own", "id"))
        root = alike(group, own, a != b, sketches(table.column("sketch").to_pylist()))
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], ["u", "v"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "own", "id").mapInArrow(compare, "u bigint, v bigint")


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the sets with an exact similarity of at least the threshold.

    Without ``right`` the pairs i < j of ``left``. Sizes of intersections come
    from products of incidence matrices over the shingles that occur twice.
    """
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = counts[column] > 1
    owner, column = owner[often], (np.cumsum(counts > 1) - 1)[column[often]]
    n, width = len(left), int((counts > 1).sum())
    rows = n if right is None else len(right)
    common = np.zeros((n, rows), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for a in range(0, width, COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        block = np.zeros((len(sets), min(COLUMNS, width - a)), dtype=np.float32)
        block[owner[lo:hi], column[lo:hi] - a] = 1
        common += block[:n] @ (block[:n] if right is None else block[n:]).T
    shared = common.astype(np.int64)
    union = sizes[:n, None] + (sizes[:n] if right is None else sizes[n:])[None, :] - shared
    similar = shared * THRESHOLD.denominator >= union * THRESHOLD.numerator
    if right is None:
        similar = np.triu(similar, 1)
    return np.nonzero(similar)


def _verify(groups):
    for (_, a, b), rows in groups:
        first, second = [], []
        for own, i, size, shingles in rows:
            side = first if own == a else second
            if not side or side[-1][0] != i:  # a repeated row
                side.append((i, size, np.frombuffer(shingles, "<u8")))
        if a == b:
            left, right = linked_pairs([s for _, _, s in first], None) if len(first) > 1 else (np.zeros(0, int),) * 2
        elif first and second:
            left, right = linked_pairs([s for _, _, s in first], [s for _, _, s in second])
            right = right + len(first)
        else:
            continue
        if len(left):
            both = first + second
            ids, sizes = np.array([i for i, _, _ in both]), np.array([n for _, n, _ in both])
            yield link_summary(ids, sizes, left, right)


def verified(docs: DataFrame, classes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of ``LINKS`` over all pairs of shingle sets in each block."""
    members = classes.join(blocks, "id").select("id", "doc_id", "key", "size", "n_shingles", F.col("component").alias("block"))
    dealt = deal(members, ["block"], "id", "n_shingles", CHUNK_ROWS, CHUNK_SHINGLES).drop("n_shingles")
    texts = dealt.join(docs.select(F.col("doc_id").cast("bigint"), "text"), "doc_id")
    names = ["block", "parts", "own", "id", "size", "shingles"]

    def shingles(batches):
        for batch in batches:
            column = batch.column(5).fill_null("")
            for a, b in slices_by_bytes(column, SLICE_BYTES):
                part, keys = batch.slice(a, b - a), batch.column(4).slice(a, b - a).to_pylist()
                sets = shingle_sets(column.slice(a, b - a), WORDS)
                # a doc_id may come with several texts; the block knows one of them
                right = pa.array([xxhash.xxh3_128_digest(s.tobytes()) == k for s, k in zip(sets, keys, strict=True)], pa.bool_())
                column_of = [*part.columns[:4], batch.column(6).slice(a, b - a), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(column_of, names).filter(right)

    sets = texts.select("block", "parts", "own", "id", "key", "text", "size").mapInArrow(
        shingles, "block bigint, parts int, own int, id bigint, size bigint, shingles binary"
    )
    rows = pair_up(sets).select("block", "a", "b", "own", "id", "size", "shingles")
    return map_sorted_groups(rows, ["block", "a", "b"], ["own", "id"], _verify, LINKS)


def linked_documents(docs: DataFrame, target: float = TARGET_RECALL) -> DataFrame:
    """doc_id, mark, n_shingles of each document, and what its shingle set tells:
    component (a number of the group), class_id, copy_id, n_links; null without words."""
    signed = settle(sign_documents(docs), "signatures")
    # sets have numbers of their own: a doc_id may come with several texts
    classes = settle(
        signed.filter("key is not null and doc_id is not null")
        .groupBy("key")
        .agg(
            F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("size"), F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"), F.first("sketch").alias("sketch"),
        )
        .withColumn("id", F.monotonically_increasing_id()),
        "classes",
    )
    documents = settle(signed.select("doc_id", "mark", "key", "n_shingles"), "documents")
    discard(signed)
    neighbours = settle(trie_neighbours(classes.select("id", "signature", "sketch")), "neighbours")
    prefix = matched_prefix(neighbours, target)
    pairs = neighbours.filter("v is not null").select("u", "v", "shared", "tree", "label").unionByName(stitched(neighbours))
    blocks = components(candidate_edges(classes, pairs, prefix))
    links = settle(verified(docs, classes.drop("signature", "sketch"), blocks), "links")
    counted = links.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("id").alias("u"), F.col("root").alias("v")))
    judged = settle(
        classes.select("key", "id", "doc_id", "size")
        .join(counted, "id", "left")
        .join(roots, "id", "left")
        .select(
            "key", F.col("doc_id").alias("copy_id"), F.coalesce("component", "id").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
        ),
        "judged",
    )
    named = judged.groupBy("component").agg(F.min("copy_id").alias("class_id"))
    known = documents.filter("doc_id is not null").join(judged.join(named, "component"), "key", "left").drop("key")
    return known.unionByName(documents.filter("doc_id is null").drop("key"), allowMissingColumns=True)


def similar_documents(docs: DataFrame, target: float = TARGET_RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, copy_id, n_links, n_shingles.

    Documents link if the Jaccard similarity of their sets of five-word
    shingles is at least 0.8; words are runs of anything but ASCII white space.
    ``class_id`` is the smallest doc_id reachable by links, ``copy_id`` the
    smallest doc_id with the very same set, ``n_links`` the number of other
    documents linked directly, copies included.

    A text of fewer than five words is one shingle; null, empty and blank texts
    have none and link with nothing, like rows with a null doc_id. Rows that
    repeat a doc_id count as documents, each linked by its own text. An empty
    table gives no rows. Further columns are ignored. Equality of shingles is
    that of 64-bit hashes.
    """
    return linked_documents(docs, target).select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("copy_id", "doc_id").alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        "n_shingles",
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """One document of each group of linked ones, with all its columns.

    The smallest doc_id of a group stays; of its texts in the group, that of
    smallest hash. Documents without words stay, and of rows that repeat both
    doc_id and text one. Rows with a null doc_id stay. Texts move once.
    """
    found = settle(linked_documents(docs).filter("doc_id is not null").select("doc_id", "mark", "component"), "linked")
    first = found.filter("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "mark")).alias("s")).select("s.*")
    stay = first.unionByName(found.filter("component is null").select("doc_id", "mark").distinct())
    stay = stay.select(F.col("doc_id").alias("stays"), F.col("mark").alias("stays_mark"))
    rows = docs.filter("doc_id is not null").select(whole_row(docs).alias("row"))
    joined = rows.join(stay, (F.col("row.doc_id").cast("bigint") == F.col("stays")) & (F.xxhash64("row.text") == F.col("stays_mark")))
    again = Window.partitionBy("stays", "stays_mark").orderBy(F.xxhash64(*[F.col(f"row.`{c}`").cast("string") for c in docs.columns]))
    one = joined.withColumn("n", F.row_number().over(again)).filter("n = 1").select("row.*")
    return one.unionByName(docs.filter("doc_id is null"))
