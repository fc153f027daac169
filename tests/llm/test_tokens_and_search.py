"""Piece codec, token alignment and lexical search against plain restatements."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tillstar.llm import agenda, align, pieces, search, tokens

FOLDER = "/root/testdata/sf0.001"
ODD_PARTS = [
    "a", "the ", "Word,", "  ", " ", "\n", "\n\n", "\t", "'s", "é", "ß", "İ", "１", "　", "\x1c", "漢字", "😀", "<s>", "é", "...",
    "x.\ny", "▁", "<0x41>", "\x00", "lo" * 60, " hello", "!?", "12", " " * 20, "한국", "ﬁ", "​", "ing", "<|endoftext|>",
]


def odd_texts(seed, n, longest=14):
    rng = random.Random(seed)
    return ["".join(rng.choices(ODD_PARTS, k=rng.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def piece_library():
    return sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary_path(pieces.VOCABULARY))


def decimals(ids):
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


# the agenda


def merged_plainly(word, rules):
    word = list(word)
    while True:
        ranked = [(rules[pair][0], i) for i, pair in enumerate(zip(word, word[1:])) if pair in rules]
        if not ranked:
            return word
        _, i = min(ranked)
        word[i : i + 2] = [rules[word[i], word[i + 1]][1]]


def test_agenda_takes_the_best_leftmost_pair_each_time():
    rng = random.Random(2)
    rules = {}
    for i in range(60):  # equal ranks too, as piece scores have them
        rules.setdefault((rng.randrange(20), rng.randrange(20)), (rng.randrange(30), 4 + i % 16))
    left, right = np.array(list(rules)).T
    rank, merged = np.array(list(rules.values())).T
    table = agenda.Merges(left, right, rank, merged)
    words = [[rng.randrange(6) for _ in range(rng.choice([0, 1, 2, 5, 9, 39, 40, 41, 90, 300]))] for _ in range(400)]
    ends = np.cumsum([len(w) for w in words])
    found, found_ends = agenda.merge_words(np.array([s for w in words for s in w]), ends, table)
    assert [x.tolist() for x in np.split(found, found_ends[:-1])] == [merged_plainly(w, rules) for w in words]


def test_agenda_of_no_words():
    table = agenda.Merges(*(np.zeros(0, dtype=np.int64),) * 4)
    assert [x.tolist() for x in agenda.merge_words(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), table)] == [[], []]


# 13 SentencePiece encoding and decoding


def test_pieces_are_those_of_the_library(piece_library):
    codec = pieces.codec(tokens.vocabulary_path(pieces.VOCABULARY))
    texts = [*odd_texts(7, 3000), None, "", " ", "   ", "漢字" * 400, "lo" * 3000, " " * 1000, "x" * 5000, "a b " * 3000]
    found, decoded = [], []
    for _, _, ids, ends in codec.encode(pa.array(texts, pa.string())):
        found += [x.tolist() for x in np.split(ids, ends[:-1])]
        decoded += codec.decode_slice(ids, ends)
    wanted = [piece_library.encode(t or "") for t in texts]
    assert found == wanted
    assert [d.decode() for d in decoded] == [piece_library.decode(ids) for ids in wanted]


def test_any_ids_decode_as_the_library_does(piece_library):
    codec, rng = pieces.codec(tokens.vocabulary_path(pieces.VOCABULARY)), random.Random(8)
    lists = [[rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(32_000)]) for _ in range(rng.randint(0, 8))] for _ in range(2000)]
    flat, ends = np.array([i for x in lists for i in x], dtype="<u2"), np.cumsum([len(x) for x in lists])
    assert [t.decode() for t in codec.decode_slice(flat, ends)] == [piece_library.decode(x) for x in lists]


def test_a_wrong_merge_is_found_by_the_check(monkeypatch):
    codec = pieces.PieceCodec(tokens.vocabulary_path(pieces.VOCABULARY))
    monkeypatch.setattr(codec.merges, "rank", codec.merges.rank.max() - codec.merges.rank)
    with pytest.raises(ValueError, match="differ"):
        codec.encode_slice(pa.array(["the international community"]))


def test_round_trip_of_documents(spark, documents, document_rows, no_documents, piece_library):
    found = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.round_trip(documents).collect())
    wanted = Counter()
    for doc_id, text, *_ in document_rows:
        ids = piece_library.encode(text or "")
        wanted[doc_id, len(ids), decimals(ids), hashlib.sha256(piece_library.decode(ids).encode()).hexdigest()] += 1
    assert found == wanted
    coded = pieces.encode_documents(documents)
    assert Counter(tuple(r) for r in pieces.decode_documents(coded).collect()) == Counter((d, t or "") for d, t, *_ in document_rows)
    assert pieces.round_trip(no_documents).collect() == []
    assert pieces.decode_documents(pieces.encode_documents(no_documents)).collect() == []


def test_query_agrees_with_the_library(spark, piece_library):
    from tillstar.llm.queries import op13_sentencepiece

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    rows = op13_sentencepiece(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = piece_library.encode(texts[r.doc_id] or "")
        text = piece_library.decode(ids)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), decimals(ids), hashlib.sha256(text.encode()).hexdigest())


# 11 cross-tokenizer alignment


@pytest.mark.parametrize("step", [1, 2, 3, 7, 100])
def test_merge_path_pieces_give_the_whole_merge(step):
    rng = random.Random(step)
    for _ in range(200):
        n = rng.randint(1, 60)
        a, b = (np.array([*sorted(rng.sample(range(1, n), rng.randint(0, n - 1))), n]) for _ in range(2))
        corners = align.path_corners(a, b, step)
        assert all(0 < (i2 + j2) - (i1 + j1) <= step for (i1, j1), (i2, j2) in zip(corners, corners[1:]))
        found = [x for c, d in zip(corners, corners[1:]) for x in zip(*(v.tolist() for v in align.piece_overlaps(a, b, c, d)), strict=True)]
        starts_a, starts_b = np.concatenate([[0], a[:-1]]), np.concatenate([[0], b[:-1]])
        assert sorted(found) == [
            (i, j, a[i] == b[j]) for i in range(len(a)) for j in range(len(b)) if max(starts_a[i], starts_b[j]) < min(a[i], b[j])
        ]
        overlaps, partner, group = align.merge_ends(a, b, step)
        assert overlaps.sum() == len(found)
        assert [b[p] if p >= 0 else None for p in partner] == [x if x in b else None for x in a]
        assert group.tolist() == [sum(x in b for x in a[:i]) for i in range(len(a))]


def aligned_plainly(rows):
    """Rows of the alignment for (doc_id, text) by walking over bytes."""
    a_library = Tokenizer.from_file(tokens.vocabulary_path(align.BYTE_VOCABULARY))
    a_library.encode_special_tokens = True
    b_library = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary_path(align.PIECE_VOCABULARY))
    byte_of = {c: b for b, c in enumerate(tokens.byte_letters())}
    kept, count = [], Counter()
    for doc_id, text in rows:
        wanted = (" " + (text or "")).encode()
        a = a_library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_library.encode(text) if text else []
        bytes_a = [bytes(byte_of[c] for c in a_library.id_to_token(i)) for i in a]
        bytes_b = [bytes([i - 3]) if b_library.is_byte(i) else b_library.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(bytes_a) != wanted or b"".join(bytes_b) != wanted:
            kept.append((doc_id, [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        both, groups, links, i, j = sorted(set(ends_a) & set(ends_b)), [], [], 0, 0
        for end in both:
            i2, j2 = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            links.append((a[i2 - 1], b[j2 - 1]))
            i, j = i2, j2
        count.update(links)
        kept.append((doc_id, (len(a), len(b)), groups, links))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    found = Counter()
    for doc_id, sizes, groups, links in kept:
        n_a, n_b = sizes or (0, 0)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        best = sum(count[link] == most[link[1]] for link in links)
        found[doc_id, n_a, n_b, len(groups), len(links), best, sum(count[link] for link in links), digest, n_a + n_b - len(groups)] += 1
    return found


def test_alignment_of_odd_documents(spark, documents, document_rows, no_documents):
    rows = [r[:2] for r in document_rows if r[1] is None or len(r[1]) < 50_000]
    small = documents.filter("text is null or length(text) < 50000")
    assert Counter(tuple(r) for r in align.align_documents(small).collect()) == aligned_plainly(rows)
    assert align.align_documents(no_documents).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id bigint, text string")
    assert Counter(tuple(r) for r in align.align_documents(nothing).collect()) == aligned_plainly([(1, None), (2, ""), (None, None)])


def test_alignment_over_many_chunks_and_pieces(spark, monkeypatch):
    rows = list(enumerate(odd_texts(9, 400, 30))) + [(1, "the end <|endoftext|> is ▁ here"), (2, "a <s> b")]
    wanted = aligned_plainly(rows)
    both = align.Aligner(tokens.vocabulary_path(align.BYTE_VOCABULARY), tokens.vocabulary_path(align.PIECE_VOCABULARY))
    monkeypatch.setattr(align.merge_ends, "__defaults__", (7,))
    ids, texts = pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])
    one, pairs = both.chunk(0, ids, texts)
    assert Counter(r["n_groups"] for r in one.to_pylist()) == Counter(k[3] for k in wanted.elements())
    assert sum(r["n"] for r in pairs.to_pylist()) == sum(k[4] for k in wanted.elements())
    found = align.align_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7))
    assert Counter(tuple(r) for r in found.collect()) == wanted


# 12 ranked lexical search

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return _TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def searched_plainly(docs, items, k=10):
    listed = [(doc_id, Counter(terms_of(text))) for doc_id, text in docs]
    listed = [(doc_id, counts) for doc_id, counts in listed if counts]
    n_docs, length = len(listed), sum(sum(c.values()) for _, c in listed)
    df = Counter(t for _, c in listed for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    found = Counter()
    for item_id, text in items:
        own, scores = set(terms_of(text)), []
        for doc_id, counts in listed:
            m = 10 + (90 * sum(counts.values()) * n_docs) // length
            score = sum(weight[t] * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 8 * m)) for t in own if t in counts)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, unknown, doc_id) in enumerate(sorted(scores)[:k], 1):
            found[item_id, rank, None if unknown else doc_id, -score] += 1
    return found


def search_cases():
    rng = random.Random(12)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(800)] + ["Été", "漢字", "A1", "b-c"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(300)]
    docs += [(300 + i, docs[i % 3][1]) for i in range(60)]  # copies tie
    docs += [(None, docs[0][1]), (None, "w1 w2"), (5, "w1 w1 w1"), (400, None), (401, ""), (402, "., ;"), (403, "w2 " * 3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)))) for i in range(40)]
    return docs, [*items, (3, "w1 w2"), (50, None), (51, "?!"), (52, "unseen"), (None, "w1 été"), (53, docs[0][1])]


def test_search_finds_the_best(spark):
    docs, items = search_cases()
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, terms string, score int").repartition(5)
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, rank string")
    assert Counter(tuple(r) for r in search.search(frame, asked).collect()) == searched_plainly(docs, items)


def test_search_in_small_blocks(spark, monkeypatch):
    docs, items = search_cases()
    monkeypatch.setattr(search.query_blocks, "__defaults__", (7, 30))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    asked = spark.createDataFrame(items[:12], "item_id bigint, text string")
    assert Counter(tuple(r) for r in search.search(frame, asked, 3).collect()) == searched_plainly(docs, items[:12], 3)


def test_search_of_empty_tables(spark, no_documents):
    asked = spark.createDataFrame([(1, "the")], "item_id bigint, text string")
    nothing = spark.createDataFrame([], asked.schema)
    docs = spark.createDataFrame([(1, "the"), (2, None)], "doc_id bigint, text string")
    assert search.search(no_documents, asked).collect() == []
    assert search.search(docs, nothing).collect() == []
    assert search.search(docs.filter("text is null"), asked).collect() == []
    assert search.search(docs, asked).columns == ["item_id", "rank", "doc_id", "score"]


def test_accumulators_are_limited_and_survivors_exact():
    rng = np.random.default_rng(3)
    n, weights = 500, np.array([9000, 5000, 300, 200, 100, 50])
    held = [sorted(rng.choice(n, size, replace=False).tolist()) for size in (15, 40, 200, 300, 400, 450)]
    lists = [[t for t in range(6) if d in held[t]] for d in range(n)]
    as_bytes = [np.array(x, "<u4").tobytes() for x in lists]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([30] * n), pa.array(as_bytes, pa.binary()), pa.array([np.ones(len(x), "<u4").tobytes() for x in lists], pa.binary())],
        ["n", "terms", "counts"],
    )
    shard = search.Shard(batch, weights, n, 30 * n)
    part = 1_000_000_000 // (1000 + 8 * 100)
    exact = np.array([int(weights[x].sum()) * part for x in lists])
    total, made = shard.scores(np.arange(6), 0)
    assert 1 <= made < 6
    best = np.sort(exact)[-10:]
    assert np.array_equal(np.sort(total)[-10:], best)
    seen = sorted({d for t in range(made) for d in held[t]})
    assert np.array_equal(total[seen], exact[seen])
    assert (total[[d for d in range(n) if d not in seen]] == 0).all()
    assert shard.scores(np.arange(6), 10**12)[1] == 0
