"""The registered queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmesh.llm import byte_bpe, decontamination, exact_dedup, importance, licenses, manifest, pii, piece_codec, simhash, token_counts, token_shards, toxicity, url_filter
from seqmesh.session import scratch, table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled outcomes of pages are the rows of ``labels`` with the page's id: low quality is bad."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return url_filter.url_filter(table(spark, sf_dir, "pages"), outcomes)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents")).drop("tag")


_SUFFIXES = ", ".join(f"'{x}'" for x in url_filter.SUFFIXES)
_OP1 = rf"""
WITH parsed AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
known AS (SELECT doc_id AS page_id, max(1 - quality) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
named AS (SELECT page_id, host, regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '\.$', '') AS bare FROM parsed),
cut AS (SELECT page_id, host, bare, string_split(bare, '.') AS labels, array_to_string(string_split(bare, '.')[-2:], '.') AS two, regexp_matches(bare, '^([0-9]+(\.[0-9]+){{3}}|\[.*\])$') AS numeric FROM named),
placed AS (
  SELECT page_id, host, CASE WHEN numeric THEN bare WHEN two IN ({_SUFFIXES}) THEN array_to_string(labels[-3:], '.') ELSE two END AS domain,
         CASE WHEN numeric THEN '{url_filter.NUMERIC}' WHEN two IN ({_SUFFIXES}) THEN two ELSE labels[-1] END AS suffix FROM cut),
hosts AS (
  SELECT host, domain, suffix, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k
  FROM placed LEFT JOIN known USING (page_id) GROUP BY host, domain, suffix),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
units AS (SELECT 'h' AS level, n, k FROM hosts UNION ALL SELECT 'd', n, k FROM domains UNION ALL SELECT 's', n, k FROM suffixes),
sums AS (SELECT level, count(*) AS m, sum(n) AS n, sum(k) AS k, sum(k * k / n) AS q, sum(n * n) AS nn FROM units WHERE n > 0 GROUP BY level),
parts AS (
  SELECT level, (q - k * k / n) / (m - 1) AS b, (k - q) / (n - m) AS w, (n - nn / n) / (m - 1) AS size FROM sums WHERE m > 1 AND n > m),
rho AS (SELECT level, least(greatest(CASE WHEN b + (size - 1) * w > 0 THEN (b - w) / (b + (size - 1) * w) ELSE 0.001 END, 0.001), 0.5) AS r FROM parts),
strength AS (SELECT level, round((1 - r) / r, 6) AS v FROM rho),
v AS (SELECT coalesce((SELECT v FROM strength WHERE level = 's'), 1.0) AS s, coalesce((SELECT v FROM strength WHERE level = 'd'), 1.0) AS d,
             coalesce((SELECT v FROM strength WHERE level = 'h'), 1.0) AS h, (SELECT (1 + coalesce(sum(k), 0)) / (2 + coalesce(sum(n), 0)) FROM suffixes) AS top),
mean_s AS (SELECT suffix, (v.s * v.top + k) / (v.s + n) AS mean_s FROM suffixes, v),
mean_d AS (SELECT domain, (v.d * mean_s + k) / (v.d + n) AS mean_d FROM domains JOIN mean_s USING (suffix), v),
post AS (SELECT host, n, (v.h * mean_d + k) / (v.h + n) AS mean FROM hosts JOIN mean_d USING (domain), v),
blocked AS (SELECT host FROM post, v WHERE mean - 1.645 * sqrt(mean * (1 - mean) / (v.h + 1 + n)) > 0.2)
SELECT page_id, p.host, path,
  CASE WHEN (p.host = 'example.net' OR ends_with(p.host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (p.host = 'example.com' OR ends_with(p.host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (p.host = 'org' OR ends_with(p.host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (p.host = 'net' OR ends_with(p.host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
  CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'net/' THEN 'block'
       ELSE CASE WHEN blocked.host IS NULL THEN 'allow' ELSE 'block' END END AS verdict
FROM parsed p LEFT JOIN blocked ON p.host = blocked.host
"""
_OP4 = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/token-shards-{uuid.uuid4().hex[:8]}"
    token_shards.write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end=0)
    return token_shards.read_shards(spark, path)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), seed=2024, percent=10, n=1, buckets=10_000, least=20)


def op12_piece_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.tampered(table(spark, sf_dir, "documents"))


# CRC-32 of a text from the hex form of its bytes, with the table of its polynomial worked out by rule.
_CRC = """crc_table AS (
  SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY i) AS steps
  FROM (SELECT unnest(range(256)) AS i))"""


def _crc(text: str) -> str:
    hexed = f"hex(encode({text}))"
    data = f"list_transform(range(0, len({hexed}) // 2), lambda k: ('0x' || substr({hexed}, 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce([4294967295] || {data}, lambda a, b: xor(a // 256, steps[xor(a % 256, b) + 1])), 4294967295)"


_OP11 = rf"""
WITH {_CRC},
cut AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
target AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark),
grams AS (SELECT row, word, count(*) AS n FROM (SELECT row, unnest(words) AS word FROM cut) GROUP BY ALL),
hashed AS (SELECT word, {_crc("word")} % 10000 AS bucket FROM (SELECT word FROM grams UNION SELECT word FROM target), crc_table),
source_counts AS (SELECT bucket, sum(n) AS s FROM grams JOIN hashed USING (word) GROUP BY bucket),
target_counts AS (SELECT bucket, count(*) AS t FROM target JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM source_counts)::DOUBLE AS all_s, (SELECT coalesce(sum(t), 0) FROM target_counts)::DOUBLE AS all_t),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain
  FROM source_counts LEFT JOIN target_counts USING (bucket), sums),
weights AS (SELECT row, sum(n * gain)::BIGINT AS weight FROM grams JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY row),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM cut LEFT JOIN weights USING (row)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * fit // 100 THEN r END AS rank FROM ranked
"""


def _leaf(n_chars: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(parts)})"


_OP13 = f"""
WITH RECURSIVE {_CRC},
docs AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
    CASE WHEN {_crc("coalesce(doc_id::VARCHAR, '1')")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS other
  FROM documents, crc_table),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
    dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree FROM docs),
nodes AS (
  SELECT tree, 0 AS level, i, n, leaf AS h FROM placed
UNION ALL
  SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, level, i // 2, n),
tops AS (
  SELECT 0 AS level, tree AS i, count(*) OVER () AS n, h FROM nodes WHERE n = 1
UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 2, n),
ways AS (
  SELECT row_number() OVER () AS row, doc_id, leaf, tree, 0 AS level, false AS top, i, n, other AS h, '' AS proof FROM placed
UNION ALL
  SELECT row, doc_id, leaf, tree, CASE WHEN w.n = 1 THEN 0 ELSE level + 1 END, top OR w.n = 1,
    CASE WHEN w.n = 1 THEN tree ELSE w.i // 2 END, CASE WHEN w.n = 1 THEN (SELECT count(DISTINCT tree) FROM placed) ELSE (w.n + 1) // 2 END,
    CASE WHEN w.n = 1 THEN w.h WHEN sibling IS NULL THEN sha256(w.h) WHEN w.i % 2 = 0 THEN sha256(w.h || sibling) ELSE sha256(sibling || w.h) END,
    CASE WHEN w.n = 1 THEN proof ELSE proof || coalesce(sibling, '') END
  FROM (
    SELECT w.*, coalesce(a.h, b.h) AS sibling FROM ways w
    LEFT JOIN nodes a ON NOT w.top AND w.n > 1 AND a.tree = w.tree AND a.level = w.level AND a.i = xor(w.i, 1)
    LEFT JOIN tops b ON w.top AND w.n > 1 AND b.level = w.level AND b.i = xor(w.i, 1)) w
  WHERE w.n > 1 OR NOT w.top)
SELECT doc_id, leaf, (SELECT h FROM nodes z WHERE z.tree = w.tree AND z.n = 1) AS subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM ways w, (SELECT h AS root FROM tops WHERE n = 1) WHERE w.top AND w.n = 1
"""

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_bpe_encode_decode": op6_bpe_encode_decode,
    "op7_pii": op7_pii,
    "op8_token_shards": op8_token_shards,
    "op9_license_scan": op9_license_scan,
    "op10_decontamination": op10_decontamination,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_piece_encode_decode": op12_piece_encode_decode,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLES = {"op1_url_filter": _OP1, "op4_exact_dedup": _OP4, "op11_importance_resampling": _OP11, "op13_merkle_manifest": _OP13}
