"""The registered queries of this subpackage, with production parameters over
the whole tables, and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.llm.common import table
from paperweave.llm.curriculum import curriculum_mix
from paperweave.llm.decontaminate import benchmark_matches
from paperweave.llm.hard_negatives import hard_negatives
from paperweave.llm.importance import resample
from paperweave.llm.maxent_lm import lm_scores
from paperweave.llm.quality import quality_verdicts
from paperweave.llm.secrets import KINDS, secret_spans, spans_text
from paperweave.llm.sentencepieces import encode
from paperweave.llm.sharding import assign_shards
from paperweave.llm.simhash import near_duplicates
from paperweave.llm.substrings import remove_repeats
from paperweave.llm.token_counts import section_token_counts
from paperweave.llm.url_filter import Rule, host_path, url_verdicts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_consistent_hash_shards(spark, sf_dir):
    """Forty shards whose row counts are at most one apart."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"))
    return assign_shards(docs, 40, key="doc_id").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 byte by byte, then the ring arc by arc (2,560 steps of a recursion).
ORACLE["op1_consistent_hash_shards"] = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS n))),
texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (
  SELECT doc_id, len(h) // 2 AS n,
    list_transform(range(len(h) // 2), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT)) AS b FROM texts),
keys AS MATERIALIZED (
  SELECT doc_id, CAST(n + 16 AS BIGINT) AS size,
    CAST(xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS point
  FROM bytes CROSS JOIN crc_table),
ring AS MATERIALIZED (
  SELECT shard, point, CAST(row_number() OVER (ORDER BY point, shard, v) - 1 AS INTEGER) AS arc FROM (
    SELECT n // 64 AS shard, n % 64 AS v,
      CAST(('0x' || substr(md5('shard#' || (n // 64) || '#' || (n % 64)), 1, 8)) AS BIGINT) AS point
    FROM (SELECT unnest(range(2560)) AS n))),
placed AS MATERIALIZED (
  SELECT k.*, coalesce(r.arc, 0) AS arc, row_number() OVER (
      PARTITION BY coalesce(r.arc, 0) ORDER BY k.point, doc_id, size, text_crc32) - 1 AS nth
  FROM keys k ASOF LEFT JOIN ring r ON k.point <= r.point),
clockwise AS MATERIALIZED (
  SELECT arc, list(shard ORDER BY gap) AS pref FROM (
    SELECT a.arc, b.shard, min((b.arc - a.arc + 2560) % 2560) AS gap FROM ring a CROSS JOIN ring b GROUP BY a.arc, b.shard)
  GROUP BY arc),
arcs AS MATERIALIZED (
  SELECT c.arc, c.pref, coalesce(n, 0) AS n FROM clockwise c LEFT JOIN (SELECT arc, count(*) AS n FROM placed GROUP BY arc) USING (arc)),
start AS MATERIALIZED (
  SELECT list_transform(range(40), lambda s: c // 40 + CASE WHEN s < c % 40 THEN 1 ELSE 0 END) AS room
  FROM (SELECT count(*) AS c FROM keys)),
fill AS (
  SELECT -1 AS arc, room, room AS before, CAST([] AS BIGINT[]) AS take, CAST([] AS BIGINT[]) AS pref FROM start
  UNION ALL
  SELECT arc, list_transform(range(40), lambda s: room[s + 1] - take[list_position(pref, s)]) AS room, room AS before, take, pref
  FROM (
    SELECT arc, room, pref, list_transform(range(1, 41), lambda j:
        greatest(0, least(n, list_sum(r[1:j])) - least(n, list_sum(r[1:j]) - r[j]))) AS take
    FROM (
      SELECT a.arc, f.room, a.pref, a.n, list_transform(a.pref, lambda s: f.room[s + 1]) AS r
      FROM fill f JOIN arcs a ON a.arc = f.arc + 1))),
segments AS (
  SELECT arc, pref[j] AS shard, list_sum(take[1:j]) - take[j] AS lo, list_sum(take[1:j]) AS hi,
    (SELECT room FROM start)[pref[j] + 1] - before[pref[j] + 1] AS base
  FROM (SELECT *, unnest(range(1, 41)) AS j FROM fill WHERE arc >= 0) WHERE take[j] > 0)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(s.shard AS INTEGER) AS shard, CAST(base + nth - lo AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM placed p JOIN segments s ON s.arc = p.arc AND nth >= lo AND nth < hi
"""

URL_RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"),
             Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


@register
def op5_bloom_url_filter(spark, sf_dir):
    """Every page; listed are the URLs of pages whose document (the number in
    the path) is labelled toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("_doc")).distinct()
    number = F.regexp_extract(host_path(F.col("url"))[1], "/([0-9]{1,18})", 1)
    listed = pages.withColumn("_doc", number.try_cast("long")).join(
        toxic, "_doc", "left_semi").select("url")
    return url_verdicts(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict",
                                                         "canonical", "listed")


ORACLE["op5_bloom_url_filter"] = r"""
WITH parts AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
    array_to_string(list_sort(list_filter(
      string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|fbclid|gclid|ref)(=|\z)'))), '&') AS args
  FROM pages),
pages_c AS (
  SELECT *, CASE WHEN contains(url, '://') THEN concat(regexp_replace(host, ':(80|443)\z', ''),
      regexp_replace(path, '/+\z', ''), CASE WHEN args <> '' THEN concat('?', args) ELSE '' END) END AS canonical
  FROM parts),
list_c AS (
  SELECT DISTINCT canonical FROM pages_c
  WHERE canonical IS NOT NULL AND try_cast(regexp_extract(path, '/([0-9]{1,18})', 1) AS BIGINT) IN
    (SELECT doc_id FROM labels WHERE toxic = 1)),
ruled AS (
  SELECT p.*, l.canonical IS NOT NULL AS listed, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM pages_c p LEFT JOIN list_c l ON p.canonical = l.canonical)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN listed THEN 'block' ELSE 'allow' END AS verdict, canonical, listed
FROM ruled
"""


@register
def op7_linked_secrets(spark, sf_dir):
    """Secrets in every document."""
    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                        count("hex").alias("n_hex"), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
                        spans_text(F.col("spans")).alias("spans"))


#: Vocabulary files of public tokenizers on the driver; the jobs broadcast their content.
TOKENIZERS = os.environ.get("PAPERWEAVE_TOKENIZERS", "/opt/tokenizers")


@register
def op2_sentencepiece_viterbi(spark, sf_dir):
    """The piece ids of every document, and whether they decode to its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model", check_col="round_trip").select(
        "doc_id", F.size("ids").alias("n_ids"), "ids", "round_trip")


@register
def op9_section_tokens(spark, sf_dir):
    """Tokens of every line of every document, from whole-document encodings."""
    return section_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


@register
def op3_simhash_near_duplicates(spark, sf_dir):
    """Fingerprints of three-word shingles of every document, linked at three bits or fewer."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, radius=3)


@register
def op10_mcd_quality(spark, sf_dir):
    """Base rules and outliers of every document."""
    return quality_verdicts(table(spark, sf_dir, "documents"))


@register
def op8_benchmark_windows(spark, sf_dir):
    """Benchmark items that documents hold."""
    return benchmark_matches(table(spark, sf_dir, "documents").select("doc_id", "text"),
                             table(spark, sf_dir, "benchmark"))


@register
def op6_suffix_array_repeats(spark, sf_dir):
    """What is left of every document without repeated strings of 200 bytes."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register
def op4_maxent_scores(spark, sf_dir):
    """Scores of every document by a model that learns from six sevenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7
    return lm_scores(docs, part == 2)


@register
def op13_segment_hard_negatives(spark, sf_dir):
    """Anchors are every hundredth vector; every seventh has the label after its own."""
    vec_id, label = F.col("vec_id"), F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), "embedding")
    return hard_negatives(rows, vec_id % 100 == 0)


ORACLE["op13_segment_hard_negatives"] = """
WITH rows_in AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows_in a JOIN rows_in b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@register
def op11_line_importance(spark, sf_dir):
    """A quarter of the documents of 20 words, drawn towards the benchmark's texts."""
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


#: Words by regular expression over whole texts, CRC-32 of distinct features byte by byte.
ORACLE["op11_line_importance"] = r"""
WITH crc_table AS MATERIALIZED (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS n))),
texts AS (
  SELECT 'raw' AS side, doc_id AS id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'target', item_id, coalesce(text, '') FROM benchmark),
words AS MATERIALIZED (
  SELECT side, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS MATERIALIZED (
  SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])))) AS f FROM words),
bytes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)),
buckets AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295,
      list_transform(range(len(h) // 2), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT))),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes CROSS JOIN crc_table),
counts AS (
  SELECT bucket, count(*) FILTER (side = 'raw') AS s, count(*) FILTER (side = 'target') AS t
  FROM features JOIN buckets USING (f) GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM counts),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (s_all + 10000) / (CAST(s + 1 AS DOUBLE) * (t_all + 10000)))) AS BIGINT) AS gain
  FROM counts CROSS JOIN sums),
weights AS (
  SELECT id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total
  FROM features JOIN buckets USING (f) JOIN gains USING (bucket) WHERE side = 'raw' GROUP BY id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features,
    CASE WHEN n_features IS NULL THEN 0 ELSE (total - ((total % n_features) + n_features) % n_features) // n_features END AS weight,
    CAST(('0x' || substr(sha256(concat('7:', d.doc_id)), 1, 8)) AS BIGINT) AS h
  FROM documents d LEFT JOIN weights w ON w.id = d.doc_id),
placed AS (
  SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight,
    CAST(weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored),
drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
  FROM placed WHERE n_features >= 39)
SELECT p.doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank
FROM placed p LEFT JOIN drawn d ON d.doc_id = p.doc_id
"""


@register
def op12_curriculum_mix(spark, sf_dir):
    """All documents, mixed by falling, steady and rising sources of weights 5, 2 and 1."""
    mixed = curriculum_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken",
                        F.transform("copies", lambda c: F.round(c["position"], 9)).alias("positions"),
                        F.transform("copies", lambda c: c["sequence"]).alias("sequences"))


ORACLE["op12_curriculum_mix"] = r"""
WITH RECURSIVE rows_in AS MATERIALIZED (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(concat('mix:', doc_id)) AS h FROM documents),
sources AS MATERIALIZED (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1]::DOUBLE AS w,
    CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) AS kind
  FROM rows_in GROUP BY source),
shares AS (
  SELECT 0 AS turn, CAST(0 AS DOUBLE) AS share
  UNION ALL
  SELECT turn + 1, (SELECT (1.5::DOUBLE * sum(source_size) - coalesce(sum(2 * source_size) FILTER (w * share > 2 * source_size), 0))
      / sum(w) FILTER (w * share <= 2 * source_size) FROM sources)
  FROM shares WHERE turn < 30),
targets AS MATERIALIZED (
  SELECT s.*, CASE WHEN w * share > 2 * source_size THEN CAST(2 * source_size AS DOUBLE) ELSE w * share END AS target
  FROM sources s CROSS JOIN (SELECT share FROM shares WHERE turn = 30)),
streamed AS MATERIALIZED (
  SELECT r.doc_id, r.source, r.size, t.source_size, t.target, t.kind, CAST(floor(t.target + 0.5) AS BIGINT) AS total,
    CAST(coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM rows_in r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT doc_id, source, epoch, start + source_size * epoch AS first_word, total, kind,
    greatest(0, least(size, total - start - source_size * epoch)) AS words
  FROM streamed CROSS JOIN (SELECT unnest([0, 1]) AS epoch)),
timed AS (
  SELECT doc_id, source, epoch, first_word, words, [7.5, 2.0, 0.5][kind + 1]::DOUBLE AS r0, [-10.0, 0.0, 2.0][kind + 1]::DOUBLE AS twice,
    CAST(first_word AS DOUBLE) / CAST(greatest(total, 1) AS DOUBLE) * [5.0, 2.0, 1.0][kind + 1]::DOUBLE AS y
  FROM copies WHERE words > 0),
placed AS (
  SELECT doc_id, source, epoch, words, first_word,
    least(0::DOUBLE + CASE WHEN y > 0 THEN 2 * y / (r0 + sqrt(greatest(r0 * r0 + twice * y, 0))) ELSE 0 END, 1) AS position FROM timed),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY position, source NULLS LAST, first_word) - 1 AS sequence FROM placed),
per_doc AS (
  SELECT doc_id, CAST(sum(words) AS BIGINT) AS taken, list(round(position, 9) ORDER BY epoch) AS positions, list(sequence ORDER BY epoch) AS sequences
  FROM ordered GROUP BY doc_id)
SELECT s.doc_id, s.size, s.source_size, s.target, coalesce(taken, 0) AS taken,
  coalesce(positions, []) AS positions, coalesce(sequences, []) AS sequences
FROM streamed s LEFT JOIN per_doc p ON p.doc_id = s.doc_id
"""
