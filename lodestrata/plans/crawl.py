"""Queries over the crawl: URLs, links, frontier, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import text as T
from lodestrata.functions import urls as U
from lodestrata.operators import crawl, dedup
from lodestrata.plans.registry import query
from lodestrata.sources.tables import table

_NORM = r"""
WITH p AS (
  SELECT id, trim(url) AS u FROM crawled_pages), s AS (
  SELECT id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 1)) AS sch,
    lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 2)) AS au,
    regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 3) AS pa,
    regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 4) AS qu FROM p), t AS (
  SELECT *, regexp_extract(au, ':([0-9]*)$', 1) AS port, regexp_replace(regexp_replace(au, ':[0-9]*$', ''), '\.+$', '') AS host,
    regexp_replace(CASE WHEN pa = '' THEN '/' ELSE pa END, '/{2,}', '/', 'g') AS sp FROM s)
SELECT id, CASE WHEN sch IN ('http', 'https') AND host <> '' AND NOT contains(au, '@') AND (port = '' OR CAST(port AS INT) BETWEEN 1 AND 65535) THEN
  sch || '://' || host || CASE WHEN port = '' OR (sch = 'http' AND port = '80') OR (sch = 'https' AND port = '443') THEN '' ELSE ':' || CAST(CAST(port AS INT) AS VARCHAR) END
  || CASE WHEN sp = '/' THEN sp ELSE regexp_replace(sp, '/+$', '') END || CASE WHEN qu = '?' THEN '' ELSE qu END END AS normalized FROM t"""


@query(_NORM)
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "crawled_pages").select("id", U.normalize_url(F.col("url")).alias("normalized"))


@query(r"""
SELECT id, source_url, CASE WHEN source_url IS NULL THEN NULL ELSE
  lower(regexp_extract(source_url, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)', 1)) || '://' || lower(regexp_extract(source_url, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)', 2))
  || regexp_replace(regexp_extract(source_url, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)', 3), '/+$', '') END AS canonical,
  lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)', 1)) AS host FROM knowledge_documents""")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "knowledge_documents").select("id", "source_url", U.canonical_source(F.col("source_url")).alias("canonical"), U.hostname(F.col("source_url")).alias("host"))


@query(r"""
WITH h AS (SELECT id, lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)', 1)) AS host, source_url FROM knowledge_documents)
SELECT id, CASE WHEN host LIKE '%.gov' THEN 'GOVERNMENT' WHEN host IN ('github.com', 'gitlab.com') THEN 'REPOSITORY' WHEN host IN ('arxiv.org', 'pubmed.ncbi.nlm.nih.gov') THEN 'PRIMARY_RESEARCH'
  WHEN host LIKE 'docs.%' OR contains(source_url, '/docs/') THEN 'OFFICIAL_DOCUMENTATION' ELSE 'UNKNOWN' END AS kind,
  (host = 'localhost' OR host LIKE '%.localhost' OR regexp_matches(host, '^(0|10|127)\.\d+\.\d+\.\d+$|^(169\.254|192\.168|198\.1[89])\.\d+\.\d+$|^172\.(1[6-9]|2\d|3[01])\.\d+\.\d+$|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.\d+\.\d+$|^(22[4-9]|2[3-5]\d)\.\d+\.\d+\.\d+$|^192\.0\.[02]\.\d+$|^198\.51\.100\.\d+$|^203\.0\.113\.\d+$')) AS private FROM h""")
def source_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("source_url")
    return table(spark, sf_dir, "knowledge_documents").select("id", U.source_type(u).alias("kind"), U.is_private_host(U.hostname(u)).alias("private"))


@query(r"""
WITH u AS (SELECT id, trim(target_url) AS t, source_url, regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*') AS root, regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path, normalized_target_url AS n FROM discovered_links WHERE target_url IS NOT NULL AND source_url IS NOT NULL),
r AS (SELECT id, n, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN t WHEN starts_with(t, '//') THEN regexp_extract(root, '^[^:]*:') || t WHEN starts_with(t, '/') THEN root || t
  WHEN t = '' OR starts_with(t, '#') THEN regexp_replace(source_url, '#.*$', '') || t WHEN starts_with(t, '?') THEN root || path || t ELSE root || regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') || t END AS resolved FROM u)
SELECT id, resolved, regexp_replace(resolved, '#.*$', '') = n AS as_stored FROM r""")
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets as they are written, against the page they stand on, and whether that is what was stored."""
    links = table(spark, sf_dir, "discovered_links").where("target_url IS NOT NULL AND source_url IS NOT NULL")
    r = links.select("id", "normalized_target_url", U.resolve(F.col("target_url"), F.col("source_url")).alias("resolved"))
    return r.select("id", "resolved", (F.regexp_replace("resolved", "#.*$", "") == F.col("normalized_target_url")).alias("as_stored"))


@query(f"SELECT id, sha256({T.FOLDED_SQL.format('text_content')}) AS hash FROM crawled_pages WHERE text_content IS NOT NULL")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, of whatever script."""
    pages = table(spark, sf_dir, "crawled_pages").where("text_content IS NOT NULL")
    return pages.select("id", T.content_hash(F.col("text_content")).alias("hash"))


@query(f"SELECT id, sha256({T.FOLDED_SQL.format('text_content')}) AS hash FROM crawled_pages WHERE text_content IS NOT NULL")
def content_hashes_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_hashes(spark, sf_dir)


@query("""
WITH f AS (SELECT crawl_job_id, content_hash, min(id) AS first_id FROM crawled_pages WHERE content_hash IS NOT NULL GROUP BY ALL)
SELECT p.id, CASE WHEN f.first_id < p.id THEN f.first_id END AS duplicate_of FROM crawled_pages p LEFT JOIN f USING (crawl_job_id, content_hash)""")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "crawled_pages").select("id", "crawl_job_id", "content_hash")
    return dedup.mark_duplicates(pages, ["crawl_job_id", "content_hash"], "id").select("id", "duplicate_of")


@query("SELECT content_hash, min(id) AS page_id FROM crawled_pages WHERE content_hash IS NOT NULL AND duplicate_of_page_id IS NULL GROUP BY content_hash")
def existing_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "crawled_pages").where("content_hash IS NOT NULL AND duplicate_of_page_id IS NULL")
    return pages.groupBy("content_hash").agg(F.min("id").alias("page_id"))


@query("""
WITH l AS (SELECT id, crawl_job_id, normalized_target_url AS u, target_depth, relevance_score, is_internal, row_number() OVER (PARTITION BY crawl_job_id, normalized_target_url ORDER BY id) AS rn FROM discovered_links)
SELECT l.id, CASE WHEN l.u IS NULL THEN 'INVALID_URL' WHEN rn > 1 THEN 'DUPLICATE_URL' WHEN l.target_depth > j.max_depth THEN 'DEPTH_LIMIT'
  WHEN NOT l.is_internal THEN 'EXTERNAL' WHEN l.relevance_score < j.min_relevance_score THEN 'LOW_RELEVANCE' ELSE 'SCHEDULED' END AS outcome
FROM l JOIN crawl_jobs j ON l.crawl_job_id = j.id""")
def link_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.schedule_links(table(spark, sf_dir, "discovered_links"), table(spark, sf_dir, "crawl_jobs"))


_RANKS = """
WITH q AS (SELECT crawl_job_id, normalized_target_url AS url, min(target_depth) AS depth, coalesce(max(relevance_score), 0) AS score, min(id) AS discovery FROM discovered_links WHERE normalized_target_url IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY crawl_job_id ORDER BY score DESC, depth, discovery, url) AS best_first, row_number() OVER (PARTITION BY crawl_job_id ORDER BY score, depth, discovery, url) AS worst_first,
  row_number() OVER (PARTITION BY crawl_job_id ORDER BY discovery) AS discovered, count(*) OVER (PARTITION BY crawl_job_id) AS frontier FROM q)"""
_ORDER = _RANKS + """,
g AS (SELECT *, {scored} AS scored, min(best_first) OVER w - 1 AS a, min(worst_first) OVER w - 1 AS b, count(*) OVER w AS size, (frontier - 1) // 5 AS e FROM r WINDOW w AS (PARTITION BY crawl_job_id, score)),
h AS (SELECT *, best_first - a AS j, least(best_first + (best_first - 1) // 4, frontier) AS steady, least(a + 1 + a // 4, frontier) AS begin FROM g),
p AS (SELECT crawl_job_id, url, frontier, scored, CASE WHEN NOT scored THEN discovered WHEN a + size <= frontier - e THEN steady WHEN b + size <= e THEN 5 * (b + j)
  WHEN begin < 5 * (b + 1) AND steady < 5 * (b + 1) THEN steady WHEN begin >= 5 * (b + 1) AND 5 * (b + j) < begin THEN 5 * (b + j) ELSE j + a + b END AS position FROM h)
SELECT crawl_job_id, CAST(position AS BIGINT) AS position, url, scored AND position % 5 = 0 AND position < frontier AS explore FROM p"""


@query(f"{_RANKS} SELECT crawl_job_id, url, best_first, worst_first, frontier FROM r")
def frontier_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and worst first, over every link; a target without any score counts 0."""
    return frontier_ranks_all(spark, sf_dir).drop("discovered")


@query(f"{_RANKS} SELECT crawl_job_id, url, best_first, worst_first, discovered, frontier FROM r")
def frontier_ranks_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.frontier_ranks(table(spark, sf_dir, "discovered_links")).drop("score")


@query(_ORDER.format(scored="true"))
def frontier_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best first with exploration in every job, over every link."""
    return crawl.frontier_order(table(spark, sf_dir, "discovered_links"), exploration_rate=0.2)


@query(_ORDER.format(scored="crawl_job_id IN (SELECT id FROM crawl_jobs WHERE crawl_mode = 'intelligent')"))
def frontier_order_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link; jobs in fifo mode by discovery."""
    return crawl.frontier_order(table(spark, sf_dir, "discovered_links"), exploration_rate=0.2, jobs=table(spark, sf_dir, "crawl_jobs"))


@query("""
SELECT j.id, count(p.id) AS pages, count(*) FILTER (WHERE p.crawl_status = 'COMPLETED') AS completed, count(*) FILTER (WHERE p.crawl_status = 'FAILED') AS failed,
  count(p.duplicate_of_page_id) AS duplicates, max(p.depth) AS deepest, round(avg(p.actual_page_relevance), 6) AS mean_relevance
FROM crawl_jobs j LEFT JOIN crawled_pages p ON p.crawl_job_id = j.id GROUP BY j.id""")
def crawl_job_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "crawled_pages")
    status = lambda s: F.count_if(F.col("crawl_status") == s)
    counted = pages.groupBy(F.col("crawl_job_id").alias("id")).agg(F.count("*").alias("pages"), status("COMPLETED").alias("completed"), status("FAILED").alias("failed"), F.count("duplicate_of_page_id").alias("duplicates"), F.max("depth").alias("deepest"), F.round(F.avg("actual_page_relevance"), 6).alias("mean_relevance"))
    return table(spark, sf_dir, "crawl_jobs").select("id").join(counted, "id", "left").fillna(0, ["pages", "completed", "failed", "duplicates"])


@query("""
WITH s AS (SELECT crawl_mode, count(*) AS pages, count(*) FILTER (WHERE actual_page_relevance >= 0.6) AS high, avg(actual_page_relevance) AS mean_relevance, count(*) FILTER (WHERE actual_page_relevance >= coalesce(min_relevance_score, 0.4)) AS relevant
  FROM crawled_pages p JOIN crawl_jobs j ON p.crawl_job_id = j.id WHERE actual_page_relevance IS NOT NULL GROUP BY crawl_mode)
SELECT crawl_mode, pages, round(relevant / pages, 6) AS relevant_yield, round(mean_relevance, 6) AS mean_relevance, round(high / pages, 6) AS high_hit_rate FROM s""")
def crawl_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.compare_modes(table(spark, sf_dir, "crawled_pages"), table(spark, sf_dir, "crawl_jobs"))


@query("""
SELECT l.id, 'Target URL: ' || substr(target_url, 1, 500) || chr(10) || 'Anchor: ' || substr(coalesce(anchor_text, ''), 1, 200) || chr(10) || 'Source page: ' || substr(coalesce(p.title, ''), 1, 200) || chr(10) || 'Context: ' || substr(coalesce(link_context, ''), 1, 320) AS candidate
FROM discovered_links l LEFT JOIN crawled_pages p ON p.id = l.source_page_id WHERE target_url IS NOT NULL""")
def link_candidate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    clip = lambda c, n: F.substring(F.coalesce(F.col(c), F.lit("")), 1, n)
    links = table(spark, sf_dir, "discovered_links").where(F.col("target_url").isNotNull())
    titled = links.join(table(spark, sf_dir, "crawled_pages").select(F.col("id").alias("source_page_id"), "title"), "source_page_id", "left")
    return titled.select("id", F.concat(F.lit("Target URL: "), clip("target_url", 500), F.lit("\nAnchor: "), clip("anchor_text", 200), F.lit("\nSource page: "), clip("title", 200), F.lit("\nContext: "), clip("link_context", 320)).alias("candidate"))


@query("""
WITH g AS (SELECT l.id, l.normalized_target_url AS url FROM discovered_links l WHERE l.normalized_target_url IS NOT NULL)
SELECT url, count(*) AS links FROM g WHERE NOT EXISTS (SELECT 1 FROM crawled_pages p WHERE p.normalized_url = g.url) GROUP BY url""")
def links_never_crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "discovered_links").where("normalized_target_url IS NOT NULL").groupBy(F.col("normalized_target_url").alias("url")).agg(F.count("*").alias("links"))
    crawled = table(spark, sf_dir, "crawled_pages").select(F.col("normalized_url").alias("url")).distinct()
    return links.join(crawled, "url", "left_anti")


@query("""
SELECT crawl_job_id, id, relevance_score, row_number() OVER (PARTITION BY crawl_job_id ORDER BY relevance_score DESC NULLS LAST, id) AS position FROM discovered_links
WHERE rejection_reason IS NULL AND is_internal QUALIFY position <= 20""")
def links_by_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first listing page of each job."""
    links = table(spark, sf_dir, "discovered_links").where("rejection_reason IS NULL AND is_internal")
    w = Window.partitionBy("crawl_job_id").orderBy(F.col("relevance_score").desc_nulls_last(), "id")
    return links.select("crawl_job_id", "id", "relevance_score", F.row_number().over(w).alias("position")).where("position <= 20")


@query(r"""
SELECT crawl_job_id, host, count(*) AS requests, count(*) FILTER (WHERE gap_ms < 500) AS too_soon, min(gap_ms) AS shortest_ms FROM (
  SELECT crawl_job_id, host, date_sub('millisecond', lag(crawled_at) OVER (PARTITION BY crawl_job_id, host ORDER BY crawled_at, id), crawled_at) AS gap_ms FROM (
    SELECT id, crawl_job_id, crawled_at, lower(regexp_extract(normalized_url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)', 1)) AS host FROM crawled_pages WHERE crawled_at IS NOT NULL)) GROUP BY ALL""")
def host_rate_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.rate_gaps(table(spark, sf_dir, "crawled_pages"), min_delay_ms=500)
