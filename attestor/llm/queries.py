"""The training-data operators as queries: name -> function of (spark, sf_dir), and the SQL of those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, mixing, quality, simhash, token_binary, token_counts, toxicity, url_filter, warc
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "contaminated", "matches.item_id", "matches.edits", "matches.start", "matches.end").withColumnsRenamed(
        {"item_id": "item_ids"}
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's operator where each page redirects to the front page of its site, the last two labels of its host: pages
    without a rule take their verdict from the pages of their site."""
    pages = table(spark, sf_dir, "pages")
    rows = url_filter.split_url(pages.select("url"), F.col("url")).where("host <> ''")
    front = F.concat(F.lit("http://"), F.substring_index("host", ".", -2), F.lit("/"))
    return url_filter.filter_urls(pages, redirects=rows.select(F.col("url").alias("from_url"), front.alias("to_url")))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.token_output(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_counts(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (url_aliases, op1_toxicity, op2_decontaminate, op3_exact_dedup, op4_url_filter, op5_token_binary, op6_mixing, op7_simhash, op8_quality, op9_warc, op10_token_counts)}

ORACLES: dict[str, str] = {}

ORACLES["op6_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-17|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rk
  FROM d GROUP BY source
), w AS (
  SELECT source, source_size, [1, 2, 3][(rk % 3 + 1)::INT]::BIGINT AS weight, 3 * source_size AS cap, sum(source_size) OVER ()::BIGINT AS total
  FROM s
), f AS (
  SELECT *, coalesce(sum(cap) OVER before, 0)::BIGINT AS fixed, sum(weight) OVER after::BIGINT AS free, cap / weight AS ratio
  FROM w
  WINDOW before AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), l AS (
  SELECT first((total - fixed)::DOUBLE / free ORDER BY ratio, source) AS level FROM f WHERE weight * ((total - fixed)::DOUBLE / free) <= cap
), t AS (
  SELECT source, source_size, least(weight * coalesce(level, 0), cap::DOUBLE) AS target FROM w, l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t
), r AS (
  SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS run
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), x AS (
  SELECT *, whole + CASE WHEN 2 * run - size <= 2 * rest THEN 1 ELSE 0 END AS n FROM r
)
SELECT doc_id, size, source_size, target, (n * size)::BIGINT AS taken, source, n::BIGINT AS repeats FROM x
"""

#: Nodes are reached through canonical and refresh links in either direction.
ORACLES["op4_url_filter"] = r"""
WITH RECURSIVE page AS (
  SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), part AS (
  SELECT page_id, url, html, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS h, coalesce(rest, '') AS rest FROM page
), own AS (
  SELECT page_id, url, html, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path, regexp_extract(substr(rest, length(h) + 1), '^[^#]*') AS tail
  FROM part
), link AS (
  SELECT CASE WHEN host <> '' THEN host || tail END AS a, url,
    unnest([regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
            regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) AS t
  FROM own WHERE regexp_matches(html, '(?i)canonical|http-equiv')
), full_link AS (
  SELECT a, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t
                 WHEN starts_with(t, '/') THEN regexp_extract(url, '^[^/?#]*://[^/?#]*') || t END AS t
  FROM link WHERE t <> ''
), edge AS (
  SELECT a, translate(regexp_extract(substr(t, strpos(t, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_extract(regexp_replace(substr(t, strpos(t, '://') + 3), '^[^/?#]*', ''), '^[^#]*') AS b
  FROM full_link WHERE a IS NOT NULL AND t IS NOT NULL
), sym AS (SELECT a, b FROM edge WHERE a <> b UNION SELECT b, a FROM edge WHERE a <> b
), reach(node, other) AS (
  SELECT DISTINCT a, a FROM sym UNION SELECT r.node, s.b FROM reach r JOIN sym s ON s.a = r.other
), rules(verdict, rule, own, prefix) AS (
  VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
         ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
), voted AS (
  SELECT r.node, max(CASE m.verdict WHEN 'allow' THEN 2 ELSE 1 END) AS vote
  FROM reach r JOIN LATERAL (
    SELECT verdict FROM rules
    WHERE (regexp_extract(r.other, '^[^/?]*') = own OR ends_with(regexp_extract(r.other, '^[^/?]*'), '.' || own))
      AND starts_with(regexp_extract(regexp_replace(r.other, '^[^/?]*', ''), '^[^?]*'), prefix)
    ORDER BY length(rule) DESC, verdict LIMIT 1) m ON true
  GROUP BY r.node
), fit AS (
  SELECT o.page_id, o.host, o.path, o.host || o.tail AS node, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM own o LEFT JOIN rules r ON (o.host = r.own OR ends_with(o.host, '.' || r.own)) AND starts_with(o.path, r.prefix)
  GROUP BY ALL
)
SELECT f.page_id, f.host, f.path, f.rule,
       coalesce(f.verdict, CASE v.vote WHEN 2 THEN 'allow' WHEN 1 THEN 'block' END, 'allow') AS verdict,
       CASE WHEN f.rule IS NOT NULL THEN 'rule' WHEN v.vote IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by
FROM fit f LEFT JOIN voted v ON v.node = f.node
"""

#: All pages of a site and its front page are one component, so no links need to be followed.
ORACLES["url_aliases"] = r"""
WITH rules(verdict, rule, own, prefix) AS (
  VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
         ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
), page AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), own AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(regexp_replace(coalesce(rest, ''), '^[^/?#]*', ''), '^[^?#]*') AS path FROM page
), sited AS (SELECT *, regexp_extract(host, '([^.]*\.)?[^.]*$') AS site FROM own
), node AS (
  SELECT page_id, host, path, site FROM sited UNION ALL SELECT NULL, site, '/', site FROM (SELECT DISTINCT site FROM sited WHERE host <> '')
), fit AS (
  SELECT n.*, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM node n LEFT JOIN rules r ON (n.host = r.own OR ends_with(n.host, '.' || r.own)) AND starts_with(n.path, r.prefix)
  GROUP BY ALL
), vote AS (SELECT site, max(CASE verdict WHEN 'allow' THEN 2 WHEN 'block' THEN 1 END) AS vote FROM fit WHERE host <> '' GROUP BY site
)
SELECT f.page_id, f.host, f.path, f.rule, coalesce(f.verdict, CASE vote WHEN 2 THEN 'allow' WHEN 1 THEN 'block' END, 'allow') AS verdict,
       CASE WHEN f.rule IS NOT NULL THEN 'rule' WHEN vote IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by
FROM fit f LEFT JOIN vote USING (site) WHERE f.page_id IS NOT NULL
"""

ORACLES["op3_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""
