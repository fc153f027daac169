"""Operators on pages and embeddings, and their shared parts, against plain restatements."""

from __future__ import annotations

import base64
import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tillstar.llm import links, pq_dedup, queries, shards, url_rules, warc
from tillstar.llm.common import key_bounds, range_of, store
from tillstar.session import new_folder

PAGE = "page_id bigint, url string, html string, host string, rule string, shard int, kind string"


@pytest.fixture(scope="module")
def page_rows():
    return [
        (i, url, html, "h", "r", 1, "k")
        for i, url, html in [
            (1, "http://a.org/x", "<p>é</p>"), (2, "https://b.example.org/es/1?q", "<p>é</p>"), (3, "HTTP://EXAMPLE.ORG/en/12#f", None),
            (4, None, ""), (5, "no scheme", "<p>é</p>"), (6, "http://", "x" * 3_000_000), (7, "http://x.com/fr/é\r\nEvil: 1", "p\r\n\r\nq"),
            (8, "http://org", "one"), (8, "http://org", "two"), (9, "http://notexample.org.uk/es/", "x" * 3_000_000), (None, "http://com/de/", "one"),
            (11, "a://B.C.D.Com/de/a?x://y.org/", "WARC/1.1\r\n"),
        ]
    ]


@pytest.fixture(scope="module")
def pages(spark, page_rows):
    return spark.createDataFrame(page_rows, PAGE).repartition(4)


# 2 WARC


def brute_records(rows):
    smallest = {}
    for i, _, html, *_ in rows:
        if i is not None:
            smallest[html or ""] = min(smallest.get(html or "", i), i)
    found = Counter()
    for i, _, html, *_ in rows:
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = smallest.get(html or "", i)
        revisit = i is not None and i > first
        found[i, len(payload), digest, "revisit" if revisit else "response", first if revisit else None] += 1
    return found


def test_archives_round_trip(spark, pages, page_rows):
    # the two rows with page_id 8 have payloads of their own, one of which a null id repeats
    rows = warc.archive_round_trip(spark, pages).collect()
    found = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)
    assert found == brute_records(page_rows)
    assert {r.url for r in rows if r.page_id == 7} == {"http://x.com/fr/é%0D%0AEvil: 1"}
    assert warc.archive_round_trip(spark, pages.filter("false")).count() == 0


def test_pages_that_share_an_id_keep_their_own_payloads(spark):
    rows = [(1, "u", "same"), (5, "u", "same"), (5, "v", "other payload"), (6, None, "other payload"), (6, None, "same"), (7, None, None), (9, None, "")]
    found = warc.archive_round_trip(spark, spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    kinds = {(r.page_id, r.payload_digest, r.payload_bytes): (r.record_type, r.refers_to) for r in found}
    digest = {t: warc.base32_sha1(t.encode()) for t in ("same", "other payload", "")}
    assert len(found) == len(rows) and kinds == {
        (1, digest["same"], 4): ("response", None), (5, digest["same"], 4): ("revisit", 1), (6, digest["same"], 4): ("revisit", 1),
        (5, digest["other payload"], 13): ("response", None), (6, digest["other payload"], 13): ("revisit", 5),
        (7, digest[""], 0): ("response", None), (9, digest[""], 0): ("revisit", 7),
    }


def test_archives_do_not_depend_on_partitions(spark, pages):
    def written(df):
        folder = new_folder(spark, "warc-test")
        manifest = warc.write_pages(df, folder, per_shard=1 << 20, roll=1 << 12)
        fs, root = store(folder)
        files = {f.base_name: f for f in fs.get_file_info(__import__("pyarrow").fs.FileSelector(root)) if f.base_name.endswith(".gz")}
        return sorted((r.name, r.bytes, r.records, r.sha256) for r in manifest.collect()), set(files)

    first, names = written(pages)
    second, _ = written(pages.repartition(9))
    assert first == second and len(first) > 2 and names == {name for name, *_ in first}


def test_a_commit_can_be_repeated(spark):
    folder = new_folder(spark, "commit-test")
    file = shards.ShardFile(folder, "part-0")
    file.write(b"abc", 1)
    rows = [file.close()]
    manifest = spark.createDataFrame(rows, shards.MANIFEST)
    shards.commit(manifest, folder)
    fs, root = store(folder)
    fs.delete_dir(f"{root}/_manifest")
    assert [r.bytes for r in shards.commit(manifest, folder).collect()] == [3]


def test_a_broken_record_is_noticed():
    record = warc.page_record(1, "http://a", b"payload", None)
    with pytest.raises(Exception):
        list(warc.members(__import__("io").BytesIO(record[:-5])))
    headers, block = warc.parse(next(warc.members(__import__("io").BytesIO(record))))
    with pytest.raises(ValueError):
        warc.page_of(headers, block.replace(b"payload", b"paylaod"), "f")


def test_bounds_cover_all_keys(spark):
    df = spark.createDataFrame([(i, 10) for i in range(1000)] + [(5, 10)] * 300 + [(None, 10)], "k bigint, w bigint")
    bounds = key_bounds(df, "k", "w", 1000)
    assert list(bounds) == sorted(set(bounds.tolist()))
    shard = range_of(__import__("pyarrow").array([None, -5, 0, 5, 999]), bounds).tolist()
    assert shard[0] == shard[1] == 0 and shard == sorted(shard)


# 3 URL rules


def brute_verdict(url, rules=url_rules.RULES):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_urls_are_judged_by_the_longest_rule(spark, pages, page_rows):
    found = Counter(tuple(r) for r in url_rules.judge_urls(pages, url_rules.rule_table(spark)).collect())
    assert found == Counter((i, *brute_verdict(url)) for i, url, *_ in page_rows)
    assert url_rules.judge_urls(pages.filter("false"), url_rules.rule_table(spark)).count() == 0
    none = url_rules.judge_urls(pages, spark.createDataFrame([], "host string, path string, verdict string"))
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "allow")}


def test_nested_rules_at_random(spark):
    rng = random.Random(2)
    hosts = ["a", "b.a", "c.b.a", "ab.a", "z", "a.z", "b"]
    paths = ["", "/", "/x", "/x/", "/x/y", "/xy", "/é", "/x/y/z"]
    rules = sorted({(rng.choice(hosts), rng.choice(paths)) for _ in range(40)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'q', '/x', '?x', '#/x'])}" for _ in range(500)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    for r in url_rules.judge_urls(pages, url_rules.rule_table(spark, rules)).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute_verdict(urls[r.page_id], rules), urls[r.page_id]


# 10 embeddings

VECTOR = "vec_id bigint, embedding array<float>, label int, list int, size string"


def brute_links(rows):
    def usable(e):
        return e is not None and len(e) > 0 and None not in e and all(map(math.isfinite, e)) and any(e)

    good = [(k, i, label, np.array(e, np.float32).astype(np.float64)) for k, (i, e, label, *_) in enumerate(rows) if label is not None and usable(e)]
    degree, parent = Counter(), {k: k for k in range(len(rows))}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, (x, _, la, va) in enumerate(good):
        for y, _, lb, vb in good[:a]:
            if la == lb and len(va) == len(vb) and va @ vb / (math.sqrt(va @ va) * math.sqrt(vb @ vb)) >= 0.98:
                degree[x] += 1
                degree[y] += 1
                parent[top(x)] = top(y)
    groups = defaultdict(list)
    for k, (i, *_) in enumerate(rows):
        groups[top(k)].append(i)
    return {(i, degree[k], min(groups[top(k)])) for k, (i, *_) in enumerate(rows)}


def near_vectors(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    rows = []
    for i in range(n):
        v = centres[i % 12] + rng.normal(size=dims) * rng.choice([0.0, 0.05, 0.14, 0.15, 0.16, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 2), 1, "s"))
    return rows


def test_vector_links_are_exact(spark, monkeypatch):
    monkeypatch.setattr(pq_dedup, "CHUNK_ROWS", 40)
    rows = near_vectors(300, 20, 1)
    found = pq_dedup.similar_vectors(spark.createDataFrame(rows, VECTOR)).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in found} == brute_links(rows)
    assert len(found) == 300 and all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_vector_edge_rows(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (1, one, 1, 1, "s"), (2, one, 1, 1, "s"), (3, [2.0, 4.0, 6.0], 1, 1, "s"), (4, one, None, 1, "s"), (5, None, 1, 1, "s"),
        (6, [0.0, 0.0, 0.0], 1, 1, "s"), (7, [math.nan, 1.0, 1.0], 1, 1, "s"), (8, [1.0, None, 1.0], 1, 1, "s"), (9, [], 1, 1, "s"),
        (10, [*one, 0.0], 1, 1, "s"), (11, one, 2, 1, "s"), (12, [math.inf, 1.0, 1.0], 1, 1, "s"), (13, [-1.0, -2.0, -3.0], 1, 1, "s"),
    ]
    vectors = spark.createDataFrame(rows, VECTOR)
    found = {(r.vec_id, r.n_links, r.component_id) for r in pq_dedup.similar_vectors(vectors).collect()}
    assert found == brute_links(rows)
    assert pq_dedup.similar_vectors(vectors.filter("false")).count() == 0
    assert pq_dedup.similar_vectors(vectors.filter("label is null")).collect()[0].kept


def test_screening_by_codes_loses_no_neighbour():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(400, 16))
    units = np.concatenate([base, base + rng.normal(size=base.shape) * 0.05])
    units /= np.sqrt((units * units).sum(1))[:, None]
    quantiser = pq_dedup.Quantiser(units[::2], 20)
    home = pq_dedup.nearest_of(units, quantiser.centroids)
    row, visited = quantiser.probes(units, home)
    reach = {(i, c) for i, c in zip(row.tolist(), visited.tolist(), strict=True)}
    cosine = units @ units.T
    pairs = 0
    for i, j in zip(*np.nonzero(np.triu(cosine >= 0.98, 1)), strict=True):
        a, b = (i, j) if home[i] <= home[j] else (j, i)
        assert home[a] == home[b] or (a, home[b]) in reach
        centre = quantiser.centroids[home[b]]
        code, error = quantiser.encode(units[b : b + 1] - centre)
        assert quantiser.table_distances(units[a : a + 1] - centre, code)[0, 0] <= pq_dedup.REACH + error[0]
        pairs += 1
    assert pairs > 100


# shared parts


def test_components_of_chains_stars_and_pairs(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (3, 900), (900, 3)]
    rng.shuffle(edges)
    found = {r.id: r.component for r in links.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 560)} | {3: 3, 900: 3}
    assert links.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_names_and_sql():
    numbers = [name.split("_")[0] for name in queries.QUERIES]
    assert numbers == [f"op{n}" for n in range(1, 11)]
    assert set(queries.SQL) <= set(queries.QUERIES)
