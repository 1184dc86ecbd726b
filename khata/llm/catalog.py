"""One query per operator over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from khata.llm import bloom_lm, decontaminate, hard_negatives, ngram_join, packing, periodic_runs, pii, pii_sql, qda, quality_rules, quality_rules_sql, token_files, url_lists, warc, window_dedup
from khata.llm.base import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.outliers(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), pii.KEY)


def op4_bloom_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.digests(spark, folder)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_lists.judge(url_lists.sample_captures(pages), url_lists.sample_events(pages))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qda.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, folder, index)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.dedup(table(spark, sf_dir, "documents"))


NGRAM_JOIN_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS MATERIALIZED (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, list_aggregate(w[i:i + 3], 'string_agg', ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 4)
    UNION ALL SELECT doc_id, list_aggregate(w, 'string_agg', ' ') FROM w WHERE len(w) BETWEEN 1 AND 3)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT r.a AS doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a"""


URL_LISTS_SQL = r"""
WITH cap AS MATERIALIZED (
  SELECT page_id, DATE '2023-01-01' + CAST((page_id * 37) % 730 AS INT) AS fetched,
    nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1), '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS seg FROM pages),
entries AS (SELECT DISTINCT unnest([host, array_to_string(string_split(host, '.')[-2:], '.'), host || '/' || seg]) AS entry FROM cap WHERE host IS NOT NULL),
numbered AS (SELECT entry, CAST('0x' || substr(md5(entry), 1, 7) AS BIGINT) AS n FROM entries WHERE NOT suffix(entry, '/')),
event AS (SELECT entry, n, unnest(range(0, n % 4 + 1)) AS k FROM numbered WHERE n % 3 <> 0),
daily AS (SELECT entry, CAST(DATE '2022-10-01' + CAST((n * (k + 1)) % 900 AS INT) AS DATE) AS day, max(['block', 'allow', 'remove'][(n + k) % 3 + 1]) AS action FROM event GROUP BY ALL),
span AS (SELECT entry, action, day AS since, lead(day) OVER (PARTITION BY entry ORDER BY day) AS until FROM daily),
label AS (SELECT page_id, fetched, host, seg, string_split(host, '.') AS l FROM cap WHERE host IS NOT NULL),
name AS (SELECT page_id, fetched, seg, k AS labels, array_to_string(l[len(l) - k + 1:], '.') AS name FROM (SELECT *, unnest(range(1, len(l) + 1)) AS k FROM label)),
key AS (SELECT page_id, fetched, labels, false AS path, name AS key FROM name UNION ALL SELECT page_id, fetched, labels, true, name || '/' || seg FROM name WHERE seg <> ''),
active AS (SELECT key.*, action FROM key JOIN span ON entry = key AND action <> 'remove' AND fetched >= since AND (until IS NULL OR fetched < until)),
best AS (SELECT page_id, key AS matched, action AS verdict, count(*) OVER (PARTITION BY page_id) AS n_active FROM active
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY labels DESC, path DESC, key DESC, action DESC) = 1)
SELECT page_id, host, CAST(fetched AS DATE) AS fetched, coalesce(verdict, 'none') AS verdict, matched, coalesce(n_active, 0) AS n_active FROM cap LEFT JOIN best USING (page_id)"""

WARC_SQL = """
SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT *, CASE WHEN strlen(body) >= 100 THEN min(page_id) OVER (PARTITION BY body) ELSE page_id END AS first
  FROM (SELECT page_id, coalesce(html, '') AS body FROM pages))"""

PERIODIC_RUNS_SQL = r"""
WITH doc AS MATERIALIZED (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
crc AS (SELECT rn, doc_id, w, len(w) AS n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::BIGINT[]), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS h FROM doc),
shape AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a, h // 10 AS g FROM crc),
word AS MATERIALIZED (SELECT rn, n, i, CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END AS w FROM (SELECT *, unnest(range(n)) AS i FROM shape)),
line AS MATERIALIZED (SELECT rn, n, list(w ORDER BY i) AS w FROM word GROUP BY rn, n),
gram AS MATERIALIZED (SELECT rn, n, i, array_to_string(w[i + 1:i + 16], ' ') AS s FROM (SELECT *, unnest(range(n - 15)) AS i FROM line WHERE n >= 24)),
pair AS (SELECT x.rn, x.i, y.i - x.i AS p FROM gram x JOIN gram y ON x.rn = y.rn AND x.s = y.s AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
stretch AS (SELECT rn, p, min(i) AS start, count(*) + 15 + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rn, p ORDER BY i) AS k FROM pair) GROUP BY rn, p, k HAVING count(*) + 15 + p >= greatest(24, 3 * p)),
run AS MATERIALIZED (SELECT rn, start, length, min(p) AS period FROM stretch GROUP BY rn, start, length),
per AS (SELECT rn, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS every,
  arg_min({'s': start, 'l': length, 'p': period}, {'e': -length / period, 's': start, 'p': period}) AS best FROM run GROUP BY rn),
gone AS (SELECT DISTINCT rn, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT rn, string_agg(w, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (rn, i) GROUP BY rn)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period, (1000 * best.l // best.p)::BIGINT AS exponent_milli,
  sha256(coalesce(every, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256 FROM doc LEFT JOIN per USING (rn) LEFT JOIN kept USING (rn)"""

HARD_NEGATIVES_SQL = """
WITH r AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score FROM r a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""

SUBSTRING_DEDUP_SQL = r"""
WITH doc AS MATERIALIZED (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT rn, doc_id, i, array_to_string(w[i + 1:i + 13], ' ') AS s FROM (SELECT *, unnest(range(len(w) - 12)) AS i FROM doc WHERE len(w) >= 13)),
low AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
gone AS MATERIALIZED (SELECT DISTINCT rn, unnest(range(i, i + 13)) AS i FROM win JOIN low USING (s) WHERE first < doc_id),
word AS (SELECT rn, unnest(w) AS w, unnest(range(len(w))) AS i FROM doc),
kept AS (SELECT rn, string_agg(w, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (rn, i) GROUP BY rn),
n AS (SELECT rn, count(*) AS n FROM gone GROUP BY rn)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM doc LEFT JOIN kept USING (rn) LEFT JOIN n USING (rn)"""


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_bloom_language_model": op4_bloom_language_model,
    "op5_token_files": op5_token_files,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_pii": op7_pii,
    "op8_url_filters": op8_url_filters,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_warc": op10_warc,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_substring_dedup": op13_substring_dedup,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op1_quality_rules": quality_rules_sql.sql(),
    "op2_ngram_jaccard_join": NGRAM_JOIN_SQL,
    "op7_pii": pii_sql.sql(),
    "op8_url_filters": URL_LISTS_SQL,
    "op10_warc": WARC_SQL,
    "op11_periodic_runs": PERIODIC_RUNS_SQL,
    "op12_hard_negatives": HARD_NEGATIVES_SQL,
    "op13_substring_dedup": SUBSTRING_DEDUP_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
