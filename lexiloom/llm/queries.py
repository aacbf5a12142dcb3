"""Each operator of this package as a query on the given tables, with its SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import (cap_filters, fingerprints, hard_negatives, language, licences, near_duplicates, packing, pair_bpe, quality,
                          ranked_search, suffixes, token_files, url_rules)
from lexiloom.llm.common import table
from lexiloom.session import scratch_path

# The rules that the URL query judges by.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, rules).drop("url")


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_pair_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_bpe.encode_documents(table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("byte_bpe_50k.json"), digest_only=True)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "corpus")
    token_files.write_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_files.read_corpus(spark, path).select(
        "doc_id", "start", F.floor(F.length("ids") / 4).alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.relabelled(table(spark, sf_dir, "embeddings"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digests(licences.scan(table(spark, sf_dir, "documents")))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_near_duplicates, op3_fingerprints, op4_url_rules, op5_suffixes,
                                  op6_pair_bpe, op7_token_files, op8_quality, op9_language, op10_cap_filters, op11_hard_negatives,
                                  op12_licences, op13_ranked_search)}

ORACLES = {
    "op3_fingerprints": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        e AS (SELECT doc_id, text, length(text) AS n,
                     coalesce(lead(text) OVER (ORDER BY doc_id), first(text) OVER (ORDER BY doc_id)) AS next_text FROM d),
        t AS (SELECT doc_id, n, text, next_text, left(text, n - n // 2) || left(next_text, n // 2) AS edited FROM e),
        prints AS (SELECT which, doc_id, sha256(list_aggregate(list_transform(shape, lambda s: sha256(list_aggregate(
                     list_transform(string_split(s, ';'), lambda p: sha256(p)), 'string_agg', ''))), 'string_agg', ''))
                     AS root, list_aggregate(shape, 'string_agg', '/') AS leaves
            FROM (SELECT which, doc_id, list_transform(string_split_regex(body, '\n[ \t\r]*\n\s*'),
                    lambda s: list_aggregate(list_transform(string_split(s, chr(10)),
                    lambda p: list_aggregate(list_transform(
                        string_split(regexp_replace(p, '([.!?,;:|])\s+', '\1' || chr(1), 'g'), chr(1)),
                        lambda x: left(sha256(x), 8)), 'string_agg', ',')), 'string_agg', ';')) AS shape
                  FROM (SELECT 'own' AS which, doc_id, text AS body FROM t UNION ALL SELECT 'edited', doc_id, edited FROM t
                        UNION ALL SELECT 'next', doc_id, next_text FROM t))),
        sets AS (SELECT *, list_distinct(string_split_regex(leaves, '[,;/]')) AS s FROM prints)
        SELECT t.doc_id, t.n AS n_chars, sha256(t.edited) AS edited_sha256, o.root || '#' || o.leaves AS fingerprint,
               c.root || '#' || c.leaves AS edited_fingerprint,
               CASE WHEN o.root = c.root THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(o.s, c.s)) / (len(o.s) + len(c.s)) END
                 AS near_edited,
               CASE WHEN o.root = x.root THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(o.s, x.s)) / (len(o.s) + len(x.s)) END
                 AS near_next
        FROM t JOIN sets o ON o.which = 'own' AND o.doc_id = t.doc_id JOIN sets c ON c.which = 'edited' AND c.doc_id = t.doc_id
        JOIN sets x ON x.which = 'next' AND x.doc_id = t.doc_id""",
    "op10_cap_filters": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
        good AS (SELECT * FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0
                 AND list_dot_product(x, x) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a, good b
                  WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
        reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
        SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links,
               (SELECT min(b) FROM reach WHERE reach.a = vec_id) AS component_id,
               vec_id = (SELECT min(b) FROM reach WHERE reach.a = vec_id) AS kept FROM v""",
    "op11_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding::DOUBLE[] AS x
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
        q AS (SELECT vec_id, label, list_transform(x, lambda e: floor(256 * e)) AS q FROM v
              WHERE len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
        s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
              FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
        n AS (SELECT p.a, p.b, p.score AS positive_score, s.b AS negative_id, s.score AS negative_score,
                     row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS r
              FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
        SELECT a AS anchor_id, b AS positive_id, r::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 10""",
    "op13_ranked_search": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents WHERE text IS NOT NULL),
        n AS (SELECT doc_id, len(words) AS n FROM d WHERE len(words) > 0),
        total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM d) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
              FROM tf, total GROUP BY term, docs),
        x AS (SELECT tf.doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS points
              FROM tf JOIN n USING (doc_id) JOIN w USING (term), total),
        i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        s AS (SELECT item_id, doc_id, sum(points)::BIGINT AS score FROM i JOIN x USING (term) GROUP BY ALL)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY rank <= 20""",
    "op2_near_duplicates": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle
              FROM w, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS t(i) WHERE len(words) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y USING (shingle)
                  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id WHERE x.doc_id <> y.doc_id
                  GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(nx.n) + any_value(ny.n) - count(*))),
        reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = w.doc_id AS kept
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN c ON c.a = w.doc_id""",
    "op4_url_rules": r"""
        WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
            ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
        SELECT p.page_id, p.host, p.path, r.rule, coalesce(r.verdict, 'allow') AS verdict
        FROM p LEFT JOIN LATERAL (
            SELECT r.host || r.path AS rule, r.verdict FROM rules r
            WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
            ORDER BY length(r.host || r.path) DESC LIMIT 1) r ON true""",
}
