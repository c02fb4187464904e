"""Queries ``opN_<name>``: each operator over its whole table, with the columns of its contract."""

from __future__ import annotations

import uuid
from functools import reduce

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.llm import (decontaminate, fingerprints, mixing, phrases, pii, prefix_trie, quality, sharding, simhash,
                            token_counts, toxicity, url_filter, warc)
from clausewise.llm.common import table
from clausewise.session import checkpoint_dir, cut_lineage

URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]
SHARDS = 24
#: Target shares of the tokens by domain.
MIX = {"en": 0.5, "de": 0.2, "es": 0.15, "fr": 0.15}
TOKENIZER = "word_bpe_49k.json"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(table(spark, sf_dir, "documents"), sharding.grid(SHARDS), sharding.grid(SHARDS + 1))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path(TOKENIZER)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4()}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    read = warc.read_archives(spark, path, payload=False)
    return read.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast("long").alias("refers_to"))


def labelled_domains(docs: DataFrame, labels: DataFrame, rows: int = mixing.MAX_LABELLED) -> DataFrame:
    """The documents of at most ``rows`` ids of each language (those with the smallest hash) among the
    documents that ``labels`` covers, with the language as domain: the small labelled table of the mixing
    classifier.  Only documents that are there are sampled, so a rare language keeps its rows;
    ``mixing.ROWS_OF`` carries how many a language has before the sample, for the prior, and ``mixing.SHARED``
    the rows of an id, which share its weight.  Ids are chosen on narrow rows, and at most
    ``rows * (mixing.MAX_DOMAINS + 1)`` are broadcast; texts are read where the classifier counts them."""
    known = labels.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct()
    # an id that repeats is counted before the join, so that it is one row there
    covered = cut_lineage(docs.filter("lang IS NOT NULL").groupBy("doc_id", "lang").agg(F.count(F.lit(1)).alias("_n"))
                              .join(known, "doc_id", "left_semi"))
    sizes = covered.groupBy("lang").agg(F.sum("_n").alias("n")).orderBy("lang").limit(mixing.MAX_DOMAINS + 1).collect()
    order = F.xxhash64(F.col("doc_id").cast("string"))
    parts = [covered.filter(F.col("lang") == r["lang"]).orderBy(order).limit(rows)
                    .select("doc_id", "lang", F.lit(r["n"]).alias(mixing.ROWS_OF), F.col("_n").alias(mixing.SHARED)) for r in sizes]
    none = covered.select("doc_id", "lang", F.col("_n").alias(mixing.ROWS_OF), F.col("_n").alias(mixing.SHARED)).limit(0)
    sample = cut_lineage(reduce(DataFrame.unionByName, parts, none))
    return (docs.select("doc_id", "lang", "text").join(F.broadcast(sample), ["doc_id", "lang"])
                .select(F.col("lang").alias("domain"), "text", mixing.ROWS_OF, mixing.SHARED))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rated, domains = mixing.mix(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), MIX)
    posterior = [F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)]
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("again")
    return rated.select(F.col("_id").alias("doc_id"), "n_tokens", *posterior, "rate", "copies", again).drop("again")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_decontamination, op3_sharding, op4_quality, op5_simhash,
                                   op6_token_counts, op7_warc, op8_mixing, op9_personal_data,
                                   op10_fingerprints, op11_toxicity, op12_prefix_trie, op13_phrases)}

_UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE = {
    "op1_url_filter": rf"""
WITH parsed AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {_UPPER_LOWER}), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(action, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                               ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM (SELECT DISTINCT host, path FROM parsed) JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY host, path)
SELECT page_id, parsed.host, parsed.path, rule, coalesce(action, 'allow') AS verdict
FROM parsed LEFT JOIN best ON best.host = parsed.host AND best.path = parsed.path""",
    "op2_decontamination": rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, {_UPPER_LOWER}),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, {_UPPER_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, list_slice(w, i, i + least(len(w), 10) - 1) AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
runs AS (
  SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS win
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, runs.k, item_id FROM runs JOIN win ON runs.k = win.k AND runs.win = win.win),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits))
  GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""",
    "op7_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f USING (h)""",
    "op12_prefix_trie": r"""
WITH RECURSIVE t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT c, c - c % 20 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
             lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
               lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT c FROM t)),
sizes AS (SELECT c, max(pos) AS n FROM t GROUP BY c),
known AS (SELECT ids.c, base, h, least(h, coalesce(n, 0)) AS m FROM ids LEFT JOIN sizes ON sizes.c = base),
turns AS (
  SELECT known.c, pos AS d, role, text FROM known JOIN t ON t.c = base AND pos <= h
  UNION ALL
  SELECT known.c, pos - h + m, role, text FROM known JOIN t ON t.c = known.c AND pos > h),
steps AS (
  SELECT c, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         list(struct_pack(r := role, x := text)) OVER (PARTITION BY c ORDER BY d) AS path
  FROM turns
  UNION ALL SELECT c, 0, 0, [] FROM known),
hashed AS (SELECT c, d, words, sha256(path::VARCHAR || len(path)) AS node,
                  CASE WHEN d > 0 THEN sha256(list_slice(path, 1, d - 1)::VARCHAR || (len(path) - 1)) END AS parent,
                  d = max(d) OVER (PARTITION BY c) AS ends FROM steps),
nodes AS (
  SELECT node, any_value(parent) AS parent, min(c) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM hashed GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
up(node, top) AS (
  SELECT node, node FROM nodes
  UNION ALL SELECT up.node, nodes.parent FROM up JOIN nodes ON nodes.node = up.top WHERE nodes.parent IS NOT NULL),
sums AS (
  SELECT top, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved
  FROM up JOIN nodes USING (node) LEFT JOIN kids USING (node) GROUP BY top)
SELECT nodes.conv_id, nodes.depth::BIGINT AS depth, above.conv_id AS parent_conv_id, nodes.n_convs::BIGINT AS n_convs,
       coalesce(kids.n, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, nodes.ends_sha256
FROM nodes JOIN sums ON sums.top = nodes.node LEFT JOIN kids ON kids.node = nodes.node LEFT JOIN nodes above ON above.node = nodes.parent""",
    "op13_phrases": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, words, count(*) AS f
  FROM (SELECT lang, list_slice(w, i, i + k - 1) AS words
        FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
              FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k))
  GROUP BY lang, words HAVING count(*) >= 100),
c AS (SELECT * FROM f WHERE len(words) > 1),
inside AS (
  SELECT lang, list_slice(words, i, i + k - 1) AS words, f AS longer
  FROM (SELECT *, unnest(generate_series(1, len(words) - k + 1)) AS i
        FROM (SELECT *, unnest(generate_series(2, len(words) - 1)) AS k FROM c WHERE len(words) > 2))),
kept AS (
  SELECT c.lang, c.words, c.f AS a FROM c
  LEFT JOIN (SELECT lang, words, max(longer) AS longer FROM inside GROUP BY lang, words) x ON x.lang = c.lang AND x.words = c.words
  WHERE longer IS NULL OR 100 * longer < 100 * a),
cuts AS (SELECT lang, words, a, unnest(generate_series(1, len(words) - 1)) AS k FROM kept),
scored AS (
  SELECT cuts.lang, cuts.words, a, k, l.f AS l, r.f AS r, n, 1000::HUGEINT * a * n // (l.f::HUGEINT * r.f) AS score
  FROM cuts JOIN total ON total.lang = cuts.lang
  JOIN f l ON l.lang = cuts.lang AND l.words = list_slice(cuts.words, 1, k)
  JOIN f r ON r.lang = cuts.lang AND r.words = list_slice(cuts.words, k + 1, len(cuts.words))),
best AS (
  SELECT *, array_to_string(words, ' ') AS phrase FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) WHERE rank <= 2000""",
}
