"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillstar.llm import align, fertility, jaccard_forest, langid, mixing, packing, pieces, pq_dedup, rans, search, sharding, url_rules, warc
from tillstar.llm.common import read_table


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_forest.similar_documents(read_table(spark, sf_dir, "documents"))


def op2_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, read_table(spark, sf_dir, "pages")).drop("url", "file")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(read_table(spark, sf_dir, "pages"), url_rules.rule_table(spark))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.token_round_trip(spark, read_table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op7_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(read_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(read_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.similar_vectors(read_table(spark, sf_dir, "embeddings")).drop("label")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_documents(read_table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_warc_writer": op2_warc_writer,
    "op3_url_filters": op3_url_filters,
    "op4_token_files": op4_token_files,
    "op5_source_mixing": op5_source_mixing,
    "op6_language_id": op6_language_id,
    "op7_stratified_sharding": op7_stratified_sharding,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_lexical_search": op12_lexical_search,
    "op13_sentencepiece": op13_sentencepiece,
}

SQL: dict[str, str] = {
    "op1_jaccard_join": """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 5 * common >= 4 * (x.n + y.n - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT id, b FROM reach JOIN both_ways ON other = a),
classes AS (SELECT id, min(other) AS class_id FROM reach GROUP BY id),
copies AS (
  SELECT both_ways.a AS id, min(both_ways.b) AS other
  FROM both_ways JOIN sizes x ON x.doc_id = both_ways.a JOIN sizes y ON y.doc_id = both_ways.b
  JOIN pairs p ON p.a = least(both_ways.a, both_ways.b) AND p.b = greatest(both_ways.a, both_ways.b)
  WHERE common = x.n AND common = y.n GROUP BY both_ways.a),
counts AS (SELECT a AS id, count(*) AS n_links FROM both_ways GROUP BY a)
SELECT d.doc_id, class_id, least(d.doc_id, coalesce(c.other, d.doc_id)) AS copy_id,
       coalesce(n_links, 0) AS n_links, coalesce(sizes.n, 0) AS n_shingles
FROM documents d JOIN classes ON classes.id = d.doc_id LEFT JOIN copies c ON c.id = d.doc_id
LEFT JOIN counts ON counts.id = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
""",
    "op2_warc_writer": """
WITH payloads AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages),
digests AS (
  SELECT *, list_aggregate(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT + 1, 1)),
         'string_agg', '') AS payload_digest
  FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM digests
""",
    "op3_url_filters": """
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 2) AS path
  FROM parts),
rules(rhost, rpath, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
judged AS (
  SELECT page_id, host, path,
         (SELECT max(struct_pack(n := length(rhost || rpath), rule := rhost || rpath, verdict := verdict))
          FROM rules
          WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS best
  FROM split)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged
""",
    "op5_source_mixing": """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('20240611:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
laid AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_word
  FROM sized),
by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS i
  FROM sized GROUP BY source),
weighted AS (SELECT *, (i - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM by_source),
levels AS (  -- each round fixes the sources whose share passes their cap
  SELECT 0 AS round, source, source_size, weight, cap, NULL::BIGINT AS fixed FROM weighted
  UNION ALL
  SELECT round + 1, source, source_size, weight, cap,
         CASE WHEN fixed IS NOT NULL THEN fixed
              WHEN (sum(source_size) OVER () - sum(coalesce(fixed, 0)) OVER ())::DOUBLE
                   / nullif(sum(CASE WHEN fixed IS NULL THEN weight ELSE 0 END) OVER (), 0) * weight > cap THEN cap END
  FROM levels WHERE round <= (SELECT count(*) FROM weighted)),
last_round AS (SELECT * FROM levels WHERE round = (SELECT max(round) FROM levels)),
targets AS (
  SELECT source, coalesce(fixed::DOUBLE, (sum(source_size) OVER () - sum(coalesce(fixed, 0)) OVER ())::DOUBLE
           / nullif(sum(CASE WHEN fixed IS NULL THEN weight ELSE 0 END) OVER (), 0) * weight) AS target
  FROM last_round),
sources AS (
  SELECT source, source_size, target, greatest(round(source_size / 128.0), 1)::BIGINT AS blocks,
         sum(target) OVER () AS total
  FROM targets JOIN by_source USING (source) WHERE source_size > 0),
quotients AS (
  SELECT source, target / (2 * k - 1) AS q
  FROM (SELECT source, target, unnest(range(1, 3 * blocks + 1)) AS k FROM sources)),
quotas AS (
  SELECT source, count(*) AS quota
  FROM (SELECT source FROM quotients ORDER BY q DESC, encode(source) NULLS LAST
        LIMIT (SELECT greatest(round(any_value(total) / 128.0), 1)::BIGINT FROM sources))
  GROUP BY source),
plan AS (
  SELECT source, source_size, target, blocks, coalesce(quota, 0) AS quota,
         ('0x' || substr(md5('20240612:=' || source), 1, 8))::BIGINT % blocks AS start
  FROM sources LEFT JOIN quotas USING (source)),
cut AS (
  SELECT *, (start * source_size) // blocks AS a, (((start + quota) % blocks) * source_size) // blocks AS b,
         (start + quota) // blocks AS passes
  FROM plan)
SELECT doc_id, source, size, source_size, target, quota,
       (passes * size + greatest(0, least(first_word + size, b) - first_word)
        - greatest(0, least(first_word + size, a) - first_word))::BIGINT AS taken
FROM laid JOIN cut USING (source)
""",
    "op10_embedding_dedup": """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
reach(id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT id, b FROM reach JOIN links ON other = a),
classes AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
counts AS (SELECT a AS id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN classes ON classes.id = vec_id LEFT JOIN counts ON counts.id = vec_id
""",
    "op12_lexical_search": """
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents),
item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark),
sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM sizes),
damped AS (SELECT doc_id, 10 + (90 * n * docs) // length AS m FROM sizes, corpus),
counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM counts, corpus GROUP BY term),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM item_terms JOIN weights USING (term) JOIN counts USING (term) JOIN damped USING (doc_id) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""",
}
