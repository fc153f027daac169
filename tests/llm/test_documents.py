"""Operators on documents against plain restatements of their rules."""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tillstar.llm import fertility, jaccard_forest, langid, mixing, packing, rans, sharding, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDER = "/root/testdata/sf0.001"


def library_ids(name, text):
    encoder = tokens.encoder(tokens.ByteEncoder if name.startswith("byte") else tokens.WordEncoder, tokens.vocabulary_path(name))
    return encoder.library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("kind, name", [(tokens.ByteEncoder, "byte_bpe_50k.json"), (tokens.WordEncoder, "word_bpe_49k.json")])
def test_word_by_word_ids_are_those_of_the_library(kind, name):
    rng = random.Random(5)
    parts = ["a", "the ", "Word,", "  ", " ", "\n", "\n\n", "\t", "'s", "é", "ß", "İ", "１", "　", "\x1c", "漢字", "😀", "<|endoftext|>", "é", "...", "x.\ny"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)] + [None, ""]
    found = tokens.encoder(kind, tokens.vocabulary_path(name)).encode(pa.array(texts, pa.string()))
    for text, ids in zip(texts, found, strict=True):
        assert ids.tolist() == library_ids(name, text), text


@pytest.mark.parametrize("kind, name", [(tokens.ByteEncoder, "byte_bpe_50k.json"), (tokens.WordEncoder, "word_bpe_49k.json")])
def test_added_tokens_are_those_of_a_fresh_library(kind, name):
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path(name)
    library, rng = Tokenizer.from_file(path), random.Random(6)
    parts = ["a", " b", "Word,", " ", "\n", "\u0338", "<|", "|>", "endoftext", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "é"]
    texts = ["a b <|endoftext|> c", *("".join(rng.choices(parts, k=rng.randint(0, 8))) for _ in range(2000))]
    found = [ids.tolist() for ids in tokens.encoder(kind, path).encode(pa.array(texts))]
    assert found == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert library.token_to_id("<|endoftext|>") in found[0]


# 1 n-gram Jaccard join


def shingles(text):
    words = WORD.findall(text or "")
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def test_join_finds_every_link(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(30, 120))]
        for _ in range(6):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 9999)}"
            texts.append(" ".join(own))
    sets = [shingles(t) for t in texts]
    links = [
        (i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    ]
    degree = Counter(i for pair in links for i in pair)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in jaccard_forest.similar_documents(docs).collect()}
    assert {i: r.n_links for i, r in found.items()} == {i: degree[i] for i in range(len(texts))}
    for i, j in links:
        assert found[i].class_id == found[j].class_id


def test_join_edge_rows(documents, no_documents):
    found = defaultdict(list)
    for r in jaccard_forest.similar_documents(documents).collect():
        found[r.doc_id].append((r.class_id, r.copy_id, r.n_links))
    assert found[1] == [(1, 1, 2)] and found[2] == [(1, 1, 2)] and found[3] == [(1, 3, 2)]
    assert found[4] == [(4, 4, 0)] and found[5] == [(5, 5, 0)] and found[6] == [(6, 6, 0)]
    assert found[None] == [(None, None, 0)]
    assert found[11] == [(11, 11, 1)] * 2
    assert jaccard_forest.similar_documents(no_documents).count() == 0
    kept = jaccard_forest.kept_documents(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id or 0 for r in kept.select("doc_id").collect()) == [0, 1, 4, 5, 6, 7, 8, 9, 11, 12, 13]


def test_texts_that_share_an_id_link_on_their_own(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    rows = [(1, x, 0), (1, y, 1), (2, x + " tail", 2), (3, y + " tail", 3), (3, y + " tail", 3), (4, "", 4), (4, None, 5), (4, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, mark int").repartition(4)
    found = Counter(tuple(r) for r in jaccard_forest.similar_documents(docs).collect())
    assert found == Counter({(1, 1, 1, 1, 56): 1, (1, 1, 1, 2, 56): 1, (2, 1, 2, 1, 57): 1, (3, 1, 3, 2, 57): 2, (4, 4, 4, 0, 0): 3})
    # a text of each group stays, though both groups begin with document 1
    kept = Counter((r.doc_id, r.text, r.mark) for r in jaccard_forest.kept_documents(docs).collect())
    assert kept == Counter({(1, x, 0): 1, (1, y, 1): 1, (4, "", 4): 1, (4, None, 5): 1})


def test_join_of_nothing(spark, no_documents):
    empty = no_documents.unionByName(spark.createDataFrame([(None,) * 10, (1, *(None,) * 9)], no_documents.schema))
    assert jaccard_forest.kept_documents(no_documents).collect() == []
    assert sorted(r.doc_id or 0 for r in jaccard_forest.kept_documents(empty).collect()) == [0, 1]


def test_recall_rises_as_the_prefix_gets_shorter(spark):
    values = [jaccard_forest.recall(0.8, k) for k in (6, 5, 4, 3)]
    assert values == sorted(values) and values[-1] > 0.9999999
    near = spark.createDataFrame([(0.99,)] * 50, "estimate double")
    border = spark.createDataFrame([(0.8,)] * 50, "estimate double")
    assert jaccard_forest.matched_prefix(near) == 6
    assert jaccard_forest.matched_prefix(border) == 4
    assert jaccard_forest.matched_prefix(border, 0.9999) == 5
    assert jaccard_forest.matched_prefix(border, 0.9999999) == 3


def test_links_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_forest, "CHUNK_ROWS", 4)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = jaccard_forest.similar_documents(docs).collect()
    assert {(r.class_id, r.n_links) for r in rows} == {(0, 29)}


def test_pages_of_a_template_are_no_candidates(spark, monkeypatch):
    rng = random.Random(12)
    frame = [f"t{i}" for i in range(60)]
    texts = [" ".join(frame + [f"w{rng.randint(0, 99999)}" for _ in range(70)]) for _ in range(1500)]
    texts += [f"{texts[i]} tail" for i in range(0, 1500, 50)]
    sizes = []
    verified = jaccard_forest.verified
    monkeypatch.setattr(jaccard_forest, "RUN_ROWS", 64)  # runs of more than one chunk
    monkeypatch.setattr(
        jaccard_forest, "verified",
        lambda docs, classes, blocks: (sizes.extend(r["count"] for r in blocks.groupBy("component").count().collect()), verified(docs, classes, blocks))[1],
    )
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_forest.similar_documents(docs).collect()}
    near = set(range(0, 1500, 50))
    assert found == {i: (i, int(i in near)) for i in range(1500)} | {1500 + k: (50 * k, 1) for k in range(30)}
    assert sum(n * (n - 1) // 2 for n in sizes) < len(texts) and max(sizes) < 10


def test_rows_hang_together_by_sketches():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (5, 72), dtype=np.uint8)
    coded = base[[0, 0, 1, 0, 2, 2, 3, 3, 0, 4, 4]].copy()
    coded[3, :20] ^= 0x11  # 0.72 of the hashes agree
    group = np.array([0, 0, 0, 0, 1, 1, 2, 2, 2, 3, 3])
    own = np.array([0, 0, 0, 0, 0, 1, 0, 0, 1, 0, 0])
    split = group >= 1
    root = jaccard_forest.alike(group, own, split, coded)
    assert root.tolist() == [0, 0, 2, 0, 4, 4, 6, 7, 8, 9, 10]


# 4 token files


def test_segments_survive_coding():
    rng = np.random.default_rng(1)
    counts = np.zeros(rans.VOCABULARY_SIZE, np.int64)
    ids = (rng.zipf(1.3, 100_000) % rans.VOCABULARY_SIZE).astype(np.uint16)
    counts += np.bincount(ids, minlength=len(counts))
    coder = rans.Coder(rans.scaled(counts))
    for n in (0, 1, 255, 256, 257, 100_000):
        data = coder.encode(ids[:n])
        back, size = coder.decode(memoryview(data))
        assert size == len(data) and np.array_equal(back, ids[:n])
    data = coder.encode(ids)
    assert len(data) < 2 * len(ids)
    with pytest.raises((ValueError, IndexError)):
        coder.decode(memoryview(data[:3000] + bytes([data[3000] ^ 1]) + data[3001:]))
    assert rans.scaled(np.zeros(rans.VOCABULARY_SIZE, np.int64)).sum() == 1 << rans.SCALE


def test_token_files_round_trip(spark, documents, document_rows, no_documents):
    rows = rans.token_round_trip(spark, documents).collect()
    want = sorted(
        (i is not None, i or 0, np.array([*library_ids("byte_bpe_50k.json", t), 0], "<u2").tobytes())
        for i, t, *_ in document_rows
    )
    start, expected = 0, []
    for known, i, ids in want:
        expected.append((i if known else None, start, len(ids) // 2, crc(np.frombuffer(ids, "<u2"))))
        start += len(ids) // 2
    assert sorted(rows, key=lambda r: r.start) == [(*e, r.file) for e, r in zip(expected, sorted(rows, key=lambda r: r.start), strict=True)]
    assert rans.token_round_trip(spark, no_documents).count() == 0


# 5 mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        share = (total - sum(fixed.values())) / max(sum(weight[s] for s in free), 1)
        over = [s for s in free if share * weight[s] > most * sizes[s]]
        if not over:
            return {s: fixed.get(s, share * weight[s]) for s in names}
        fixed |= {s: most * sizes[s] for s in over}


def brute_quotas(targets, sizes, block, total):
    seats, blocks = Counter(), {s: max(round(n / block), 1) for s, n in sizes.items()}
    for _ in range(total):
        open_ = [s for s in targets if seats[s] < 3 * blocks[s] and sizes[s]]
        if open_:
            seats[max(open_, key=lambda s: targets[s] / (2 * seats[s] + 1))] += 1
    return seats


def test_mix_follows_targets_and_quotas(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(0, 400), f"s{min(i % 13, 7)}") for i in range(600)] + [(999, "w " * 5, "tiny"), (1000, "w w", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = mixing.mix(docs).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    targets = brute_targets(sizes)
    taken = Counter()
    for r in found:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        taken[r.source] += r.taken
    total = max(round(sum(targets.values()) / mixing.BLOCK_WORDS), 1)
    quotas = brute_quotas(targets, sizes, mixing.BLOCK_WORDS, total)
    assert {r.source: r.quota for r in found} == {s: quotas[s] for s in sizes}
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 2 * mixing.BLOCK_WORDS
    assert sorted(mixing.mix(docs.repartition(5)).collect(), key=str) == sorted(found, key=str)


def test_shard_quotas_add_up_and_stay_proportional(spark):
    targets = spark.createDataFrame([("a", 50_000, 1, 30_000.0), ("b", 50_000, 2, 60_000.0), (None, 40_000, 3, 10_000.0)], "source string, source_size bigint, weight int, target double")
    rows = mixing.shard_quotas(targets, 100, 10).collect()
    per_shard = Counter()
    for r in rows:
        per_shard[r.shard] += r.quota
        assert r.quota >= 0 and abs(r.quota - {"a": 30, "b": 60, None: 10}[r.source]) <= 1
    assert set(per_shard.values()) == {100}


def test_mix_edge_rows(documents, no_documents):
    rows = mixing.mix(documents).collect()
    assert len(rows) == documents.count()
    assert all(r.size == 0 and r.taken == 0 for r in rows if r.doc_id in (4, 5, 6))
    assert mixing.mix(no_documents).count() == 0
    assert mixing.mixed_documents(no_documents).count() == 0
    mixed = mixing.mixed_documents(documents)
    assert mixed.columns == documents.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert copies and max(v for k, v in copies.items() if k != 11) <= 3


# 6 language ID


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    outside = [r for r in rows if r.held_out]
    assert {r.doc_id for r in outside} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert sum(r.lang == r.lang_pred for r in outside) >= 0.95 * len(outside)
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixtures_are_found(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("length(text) > 1500")
    model = langid.fit(docs)
    english = docs.filter("lang = 'en'").first().text[:1000]
    french = docs.filter("lang = 'fr'").first().text[:500]
    both = spark.createDataFrame([(1, english + " " + french), (2, english)], "doc_id bigint, text string")
    found = {r.doc_id: r for r in langid.identify(both, model).collect()}
    assert found[1].languages == ["en", "fr"] and 0.5 < found[1].score < 0.85
    assert found[2].languages == ["en"] and found[2].score == 1


def test_language_edge_rows(documents, no_documents):
    model = langid.fit(documents)
    found = {r.doc_id: r for r in langid.identify(documents, model).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (4, 5, 6, 13))
    assert found[None].held_out and found[None].lang_pred in model.languages
    assert langid.identify(no_documents, model).count() == 0
    nothing = langid.fit(no_documents)
    assert {r.lang_pred for r in langid.identify(documents, nothing).collect()} == {"und"}
    kept = langid.kept_documents(documents, model)
    assert kept.columns == documents.columns and kept.filter("doc_id in (4, 5, 6, 13)").count() == 0


# 7 sharding


def test_shards_match_the_mixture(spark):
    rows = [(i, "x" * (i % 50), f"s{0 if i % 3 == 0 else i % 17}") for i in range(4001)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = sharding.assign_shards(docs).collect()
    slots, mixture, whole = defaultdict(list), Counter(), Counter()
    for r in found:
        slots[r.shard].append(r.slot)
        mixture[r.shard, r.source] += 1
        whole[r.source] += 1
    assert len(slots) == 40 and {len(s) for s in slots.values()} == {100, 101}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for shard, own in slots.items():
        for source, n in whole.items():
            assert abs(mixture[shard, source] - n * len(own) / len(rows)) <= 2
    assert sorted(sharding.assign_shards(docs.repartition(7)).collect()) == sorted(found)


def test_shard_edge_rows(documents, document_rows, no_documents):
    found = sharding.shard_digest(documents).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in document_rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == want
    assert {r.law for r in found} == {"rows"} and {r.slot for r in found} == {0}
    assert len({r.shard for r in found}) == len(found) < 40
    assert sharding.shard_digest(no_documents).count() == 0


# 8 quality rules


def brute_base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (
        len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
    )


def test_base_rules_of_every_document(spark, documents, document_rows, no_documents):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()} | {r[0]: r[1] for r in document_rows if r[0] is not None and r[0] < 0}
    for r in fertility.judge(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    found = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in fertility.judge(documents).collect())
    assert found == Counter((i, *brute_base(t)) for i, t, *_ in document_rows)
    assert fertility.judge(no_documents).count() == 0


def test_bands_reject_what_is_no_prose(spark):
    rng = random.Random(4)
    digits = " ".join(str(rng.randrange(10**15)) for _ in range(80))
    codes = " ".join("%032x" % rng.getrandbits(128) for _ in range(80))
    bytes_ = " ".join("".join(chr(rng.randrange(0x1F300, 0x1F5FF)) for _ in range(5)) for _ in range(80))
    prose = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("length(text) between 1000 and 3000").limit(20)
    rows = prose.select("doc_id", "text").collect() + [(-1, digits), (-2, codes), (-3, bytes_)]
    found = {r.doc_id: r for r in fertility.judge(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert not any(found[i].base_failed or found[i].kept for i in (-1, -2, -3))
    assert all(r.kept or r.base_failed for i, r in found.items() if i >= 0)


#: From the declaration of human rights.
CLEAN = {
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình anh em. Mọi người đều được hưởng tất cả những quyền và tự do ghi trong bản Tuyên ngôn này, không có bất cứ sự phân biệt nào, như chủng tộc, màu da, giới tính, ngôn ngữ, tôn giáo, quan điểm chính trị hay quan điểm khác, nguồn gốc quốc gia hay xã hội, tài sản, dòng dõi hay các thân trạng khác.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. Každý má všechna práva a všechny svobody, stanovené touto deklarací, bez jakéhokoli rozlišování, zejména podle rasy, barvy, pohlaví, jazyka, náboženství, politického nebo jiného smýšlení, národnostního nebo sociálního původu, majetku, rodu nebo jiného postavení. Každý má právo na život, svobodu a osobní bezpečnost. Nikdo nesmí být držen v otroctví nebo nevolnictví.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek posiada wszystkie prawa i wolności zawarte w niniejszej Deklaracji bez względu na różnice rasy, koloru, płci, języka, wyznania, poglądów politycznych i innych przekonań, narodowości, pochodzenia społecznego, majątku, urodzenia lub jakiegokolwiek innego stanu.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokainen on oikeutettu kaikkiin tässä julistuksessa esitettyihin oikeuksiin ja vapauksiin ilman minkäänlaista rotuun, väriin, sukupuoleen, kieleen, uskontoon, poliittiseen tai muuhun mielipiteeseen, kansalliseen tai yhteiskunnalliseen alkuperään, omaisuuteen, syntyperään tai muuhun tekijään perustuvaa erotusta.",
}


def test_clean_latin_prose_is_kept_and_random_letters_are_not(spark):
    rng = random.Random(9)
    rows = ["qwertyuiop", "asdfghjkl", "zxcvbnm"]
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "eeeeeettttaaaooiinnsshhrrdlcumwfgypb", "ăâđêôơưạảấầẩ", *rows]
    noise = [" ".join("".join(rng.choices(a, k=rng.randint(3, 9))) for _ in range(300)) for a in alphabets for _ in range(10)]
    noise += [" ".join("".join(rng.choices(rng.choice(rows), k=rng.randint(3, 9))) for _ in range(300)) for _ in range(10)]
    clean = [*CLEAN.values(), unicodedata.normalize("NFD", CLEAN["vi"])]
    docs = spark.createDataFrame(list(enumerate(clean + noise)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in fertility.judge(docs).collect()}
    assert not any(r.base_failed for r in found.values())
    assert [i for i, r in found.items() if r.kept != (i < len(clean))] == []


#: From the declaration of human rights, in scripts whose letters are mostly tokens of their own.
CLEAN_SCRIPTS = {
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Каждый человек должен обладать всеми правами и всеми свободами, провозглашенными настоящей Декларацией, без какого бы то ни было различия, как-то в отношении расы, цвета кожи, пола, языка, религии, политических или иных убеждений",
    "uk": "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства. Кожна людина повинна мати всі права і всі свободи, проголошені цією Декларацією, незалежно від раси, кольору шкіри, статі, мови, релігії, політичних або інших переконань",
    "kk": "Барлық адамдар тумысынан азат және қадір-қасиеті мен құқықтары тең болып дүниеге келеді. Адамдарға ақыл-парасат, ар-ождан берілген, сондықтан олар бір-бірімен туыстық, бауырмалдық қарым-қатынас жасаулары тиіс. Әрбір адам нәсіліне, түсіне, жынысына, тіліне, дініне, саяси немесе басқа да нанымдарына қарамастан барлық құқықтар мен бостандықтарға ие болуға тиіс. Әрбір адам өмір сүруге, бостандыққа және жеке басының қауіпсіздігіне құқылы",
    "mn": "Хүн бүр төрж мэндлэхэд эрх чөлөөтэй, адилхан нэр төртэй, ижил эрхтэй байдаг. Оюун ухаан, нандин чанар заяасан хүн гэгч өөр хоорондоо ахан дүүгийн үзэл санаагаар харьцах учиртай. Хүн бүр энэхүү тунхаглалд заасан бүх эрх, эрх чөлөөг ямар ч ялгаваргүйгээр эдлэх ёстой Хэн боловч амьд явах, эрх чөлөөтэй, халдашгүй дархан байх эрхтэй. Хэнийг ч боолчлон зарцлах, эрхийг нь боогдуулж болохгүй",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. Κάθε άνθρωπος δικαιούται να επικαλείται όλα τα δικαιώματα και όλες τις ελευθερίες που προκηρύσσει η παρούσα Διακήρυξη, χωρίς καμία απολύτως διάκριση, ειδικότερα ως προς τη φυλή, το χρώμα, το φύλο, τη γλώσσα, τις θρησκείες",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. لكل إنسان حق التمتع بكافة الحقوق والحريات الواردة في هذا الإعلان، دون أي تمييز، كالتمييز بسبب العنصر أو اللون أو الجنس أو اللغة أو الدين أو الرأي السياسي أو أي رأي آخر، أو الأصل الوطني أو الاجتماعي",
    "fa": "تمام افراد بشر آزاد به دنیا می‌آیند و از لحاظ حیثیت و حقوق با هم برابرند. همه دارای عقل و وجدان هستند و باید نسبت به یکدیگر با روح برادری رفتار کنند. هر کس می‌تواند بدون هیچگونه تمایز، مخصوصا از حیث نژاد، رنگ، جنس، زبان، مذهب، عقیده سیاسی یا هر عقیده دیگر از تمام حقوق و کلیه آزادی‌ها بهره‌مند گردد",
    "he": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה. כל אדם זכאי לזכויות ולחרויות שנקבעו בהכרזה זו ללא הפליה כלשהיא מטעמי גזע, צבע, מין, לשון, דת, דעה פוליטית או דעה בבעיות אחרות, בגלל מוצא לאומי או חברתי",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए। सभी को इस घोषणा में सन्निहित सभी अधिकारों और आज़ादियों को प्राप्त करने का हक़ है और इस मामले में जाति, वर्ण, लिंग, भाषा, धर्म, राजनीति या अन्य विचार",
}
#: First and last letter of the random words of a script.
ALPHABETS = {
    "cyrillic": (0x0430, 0x044F), "greek": (0x03B1, 0x03C9), "arabic": (0x0641, 0x064A), "hebrew": (0x05D0, 0x05EA),
    "devanagari": (0x0905, 0x0939), "thai": (0x0E01, 0x0E2E), "armenian": (0x0561, 0x0586), "georgian": (0x10D0, 0x10F0),
}


def test_clean_prose_of_other_scripts_is_kept_and_random_letters_are_not(spark):
    rng = random.Random(11)
    consonants, vowels = "bcdfghjklmnpqrstvwxyz", "aeiou"
    noise = []
    for n in (60, 120, 300):
        for first, last in ALPHABETS.values():
            letters = [chr(c) for c in range(first, last + 1)]
            noise += [" ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(n)) for _ in range(8)]
    for n in (150, 300):
        noise += [" ".join("".join(rng.choice((consonants, vowels)[i % 2]) for i in range(rng.randint(3, 9))) for _ in range(n)) for _ in range(8)]
    clean = list(CLEAN_SCRIPTS.values())
    docs = spark.createDataFrame(list(enumerate(clean + noise)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in fertility.judge(docs).collect()}
    assert not any(r.base_failed for r in found.values())
    assert [i for i, r in found.items() if r.kept != (i < len(clean))] == []


def test_kept_documents_agree_with_the_verdicts(documents):
    verdicts = Counter(r.doc_id for r in fertility.judge(documents).filter("kept").collect())
    kept = fertility.kept_documents(documents)
    assert kept.columns == documents.columns
    assert Counter(r.doc_id for r in kept.collect()) == verdicts


# 9 packing


def brute_cost(positions, penalties, most):
    best = {0: 0}
    for j, p in enumerate(positions):
        padding = lambda n: 0 if n & (n - 1) == 0 else most - n
        toll = penalties[j] if j < len(positions) - 1 else 0
        best[p] = min(best[q] + padding(p - q) + toll for q in best if 0 < p - q <= most)
    return best[positions[-1]]


@pytest.mark.parametrize("seed", range(5))
def test_cuts_are_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    ends = np.cumsum(rng.integers(1, 60, 40))
    inner = np.setdiff1d(rng.integers(1, ends[-1], 60), ends)
    positions, penalties = packing.allowed_cuts(ends, inner, 16)
    cuts = packing.best_cuts(positions, penalties, 64)
    toll = dict(zip(positions.tolist(), penalties.tolist(), strict=True))
    cost = 0
    for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
        assert 0 < b - a <= 64
        cost += (0 if (b - a) & (b - a - 1) == 0 else 64 - (b - a)) + (toll[b] if b != positions[-1] else 0)
    assert cost == brute_cost(positions.tolist(), penalties.tolist(), 64)


def check_pieces(rows, texts):
    """Every id of every document lies in one piece; returns (tokens, padding)."""
    sequences, pieces = defaultdict(list), defaultdict(list)
    ids = {i: [*library_ids("word_bpe_49k.json", t), 1] for i, t in texts.items()}
    for r in rows:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length])
    for i, own in pieces.items():
        assert sum(p.length for p in own) % len(ids[i]) == 0
    padding = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert set(pieces) == set(texts)
    return sum(r.length for r in rows), padding


def test_pieces_of_a_corpus(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    total, padding = check_pieces(packing.pack_documents(docs).collect(), texts)
    assert total == sum(len(library_ids("word_bpe_49k.json", t)) + 1 for t in texts.values())
    assert padding < 0.02 * total


def test_packing_edge_rows(documents, document_rows, no_documents):
    rows = packing.pack_documents(documents).collect()
    check_pieces(rows, {i: t for i, t, *_ in document_rows})
    assert [r.length for r in rows if r.doc_id == 4] == [1]
    assert sum(r.start == 0 for r in rows if r.doc_id == 11) == 2
    assert packing.pack_documents(no_documents).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, FOLDER)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns, name
        seen.append((before, docs.count()))
    assert all(after <= before for before, after in seen[:3]) and seen[0][1] < seen[0][0]
    texts = {r.doc_id: r.text for r in docs.collect()}
    check_pieces(corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect(), texts)
    first, second, third = (stage for _, stage in corpus_pipeline.STAGES[:3])
    whole = spark.read.parquet(f"{FOLDER}/documents.parquet")
    good = first(spark, whole, FOLDER)
    left = {r.doc_id for r in third(spark, second(spark, good, FOLDER), FOLDER).collect()}
    sets = {r.doc_id: shingles(r.text) for r in good.collect()}
    for i in left:
        for j in left:
            assert i >= j or 5 * len(sets[i] & sets[j]) < 4 * len(sets[i] | sets[j])


# plain restatements of 6, 7 and 8


def test_shards_are_those_of_the_stated_order(spark):
    import hashlib
    from fractions import Fraction

    rng = random.Random(71)
    rows = [(rng.choice([None, *range(900)]), rng.choice([None, "", "é", "x" * rng.randrange(30)]), rng.choice([None, "a", "b", "b", "null"])) for _ in range(1500)]
    found = sharding.assign_shards(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    listed = []
    for doc_id, text, source in rows:
        key = hashlib.md5(f"20240607:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        listed.append((key, doc_id is not None, doc_id or 0, len((text or "").encode()) + 16, zlib.crc32((text or "").encode()), "null" if source is None else f"={source}"))
    by_source = defaultdict(list)
    for r in sorted(listed):  # null ids sort first, as their key is one of its own
        by_source[r[5]].append(r)
    order = sorted((Fraction(2 * rank + 1, 2 * len(own)), r) for own in by_source.values() for rank, r in enumerate(own))
    wanted = []
    for at, (_, (_, known, doc_id, size, crc32, source)) in enumerate(order):
        shard = at * 40 // len(rows)
        wanted.append((doc_id if known else None, None if source == "null" else source[1:], size, crc32, shard, at - -(-shard * len(rows) // 40)))
    assert Counter(tuple(r) for r in found) == Counter(wanted)


def plain_trigrams(text):
    words = re.findall("[a-zßà-öø-ÿ]+", text.lower())
    return [[(" " + w + " ")[i : i + 3] for i in range(len(w))] for w in words]


def test_languages_are_those_of_a_plain_mixture(spark, monkeypatch):
    """Counts, expectation-maximisation and set choice restated over text trigrams."""
    import math

    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").collect()]
    rows = [(d, t[:1500], lang) for d, t, lang in rows if t and lang and re.fullmatch(r"[\x00-\x7fÀ-ÖØ-öø-ÿñ]*", t[:1500])][:120]
    mixed = [(9000 + i, " ".join([rows[i][1][:400], rows[i + 40][1][:400]]), None) for i in range(30)]
    docs = spark.createDataFrame(rows + mixed, "doc_id bigint, text string, lang string")
    counts = defaultdict(Counter)
    for doc_id, text, lang in rows:
        if zlib.crc32(str(doc_id).encode()) % 3 != 1:
            counts[lang].update(t for w in plain_trigrams(text) for t in w)
    languages = sorted(counts)
    letters = langid.letter_table()
    bucket = lambda t: langid.trigrams(t.strip(), letters)[0]
    seen = {t for c in counts.values() for t in c} | {t for _, x, _ in rows + mixed for w in plain_trigrams(x) for t in w}
    # the operator hashes trigrams: a trigram's bucket is that of the word it is cut from
    place = {}
    for _, text, _ in rows + mixed:
        for w in plain_trigrams(text):
            place.update(zip(w, langid.trigrams("".join(t[1] for t in w), letters)[0].tolist()))
    assert set(place) == seen and bucket("a") is not None
    table = {}
    for lang in languages:
        hashed = Counter()
        for t, n in counts[lang].items():
            hashed[place[t]] += n
        total = sum(hashed.values()) + 0.5 * langid.BUCKETS
        table[lang] = lambda b, hashed=hashed, total=total: math.log((hashed[b] + 0.5) / total)

    def em(scores):
        share = [1 / len(scores[0])] * len(scores[0])
        for _ in range(30):
            new = [0.0] * len(share)
            for s in scores:
                p = [math.exp(x - max(s)) * a for x, a in zip(s, share)]
                for i, x in enumerate(p):
                    new[i] += x / sum(p) / len(scores)
            change, share = max(abs(a - b) for a, b in zip(new, share)), new
            if change < 1e-4:
                break
        return share, sum(math.log(sum(math.exp(x - max(s)) * a for x, a in zip(s, share))) + max(s) for s in scores)

    found = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    several = 0
    for doc_id, text, _ in rows[:40] + mixed:
        scores = [[sum(table[lang](place[t]) for t in w) for lang in languages] for w in plain_trigrams(text)]
        totals = [sum(s[i] for s in scores) for i in range(len(languages))]
        chosen, share, value = [totals.index(max(totals))], [1.0], max(totals)
        penalty = 2 * math.log(len(scores) + 1)
        while len(chosen) < len(languages):
            gain = [-1 if i in chosen else sum(max(s[i] - max(s[c] for c in chosen), 0) for s in scores) for i in range(len(languages))]
            following = [*chosen, gain.index(max(gain))]
            if max(gain) <= penalty:
                break
            new, reached = em([[s[i] for i in following] for s in scores])
            if reached - value <= penalty or new[-1] < 0.02:
                break
            chosen, share, value = following, new, reached
        best = sorted(zip(share, chosen), key=lambda x: -x[0])
        several += len(best) > 1
        assert found[doc_id].languages == [languages[i] for _, i in best]
        assert found[doc_id].shares == pytest.approx([s for s, _ in best], abs=2e-3)
        assert found[doc_id].score == pytest.approx(best[0][0], abs=2e-3)
    assert several > 5


def test_fertility_measures_restated(spark):
    import math

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary_path(fertility.VOCABULARY))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").limit(60)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in fertility.judge(docs).collect():
        words = WORD.findall(texts[r.doc_id])
        ids = [i for w in words for i in library.encode(w)]
        counts = Counter(ids)
        entropy = -sum(n / len(ids) * math.log(n / len(ids)) for n in counts.values()) / math.log(min(len(ids), 32_000)) if len(ids) > 1 else 0.0
        assert r.n_tokens == len(ids)
        assert r.chars_per_token == pytest.approx(sum(map(len, words)) / len(ids) if ids else 0.0)
        assert r.byte_share == pytest.approx(sum(3 <= i <= 258 for i in ids) / len(ids) if ids else 0.0)
        assert r.token_entropy == pytest.approx(entropy)
        least, most, most_bytes, least_entropy = fertility.BANDS[r.script]
        assert r.script not in fertility.DOUBTFUL
        if r.script != "latin" or r.chars_per_token >= fertility.DOUBTFUL_PER_TOKEN:
            inside = least <= r.chars_per_token <= most and r.byte_share <= most_bytes and r.token_entropy >= least_entropy
            assert r.kept == (not r.base_failed and inside)
