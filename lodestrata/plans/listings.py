"""Queries that filter, project, unite and order records: links, pages, passages, jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import scoring
from lodestrata.functions import text as T
from lodestrata.functions import urls as U
from lodestrata.operators import crawl, dedup, evaluate
from lodestrata.operators.ranking import positions, top
from lodestrata.plans.registry import query
from lodestrata.sources.tables import table, tables

_HOST = r"nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '\.+$', ''), '')"


@query("""
SELECT crawl_job_id, is_internal, count(*) AS links, count(*) FILTER (WHERE selected_for_crawl) AS selected, count(*) FILTER (WHERE rejection_reason IS NOT NULL) AS rejected FROM discovered_links GROUP BY ALL""")
def link_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All, selected and rejected links of each job, inside and outside."""
    return table(spark, sf_dir, "discovered_links").groupBy("crawl_job_id", "is_internal").agg(F.count("*").alias("links"), F.count_if("selected_for_crawl").alias("selected"), F.count("rejection_reason").alias("rejected"))


@query("""
SELECT id, 'Title: ' || substr(coalesce(title, ''), 1, 200) || chr(10) || 'Description: ' || substr(coalesce(meta_description, ''), 1, 300) || chr(10) || 'Content: ' || substr(text_content, 1, 4000) AS page_text FROM crawled_pages WHERE text_content IS NOT NULL""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page's embedding is made of; the caps are those of the form."""
    clip = lambda c, n: F.substring(F.coalesce(F.col(c), F.lit("")), 1, n)
    p = table(spark, sf_dir, "crawled_pages").where("text_content IS NOT NULL")
    return p.select("id", F.concat(F.lit("Title: "), clip("title", 200), F.lit("\nDescription: "), clip("meta_description", 300), F.lit("\nContent: "), clip("text_content", 4000)).alias("page_text"))


@query("SELECT id, substr(coalesce(anchor_text, ''), 1, 300) || chr(10) || substr(coalesce(link_context, ''), 1, 1000) || chr(10) || substr(coalesce(target_url, ''), 1, 500) AS result_text FROM discovered_links")
def result_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link as a search result: title, snippet and URL."""
    clip = lambda c, n: F.substring(F.coalesce(F.col(c), F.lit("")), 1, n)
    return table(spark, sf_dir, "discovered_links").select("id", F.concat_ws("\n", clip("anchor_text", 300), clip("link_context", 1000), clip("target_url", 500)).alias("result_text"))


@query("""
WITH t AS (SELECT c.id, c.research_job_id, 'Title: ' || coalesce(d.title, '') || chr(10) || 'Section: ' || coalesce(c.heading, '') || chr(10) || 'Passage: ' || coalesce(c.text, '') AS t FROM knowledge_chunks c LEFT JOIN knowledge_documents d ON d.id = c.document_id)
SELECT research_job_id, sha256(t) AS passage_key, min(id) AS first_id, count(*) AS passages FROM t GROUP BY ALL""")
def passage_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of a job with the same title, section and words are one."""
    c, d = tables(spark, sf_dir, "knowledge_chunks", "knowledge_documents")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    t = c.join(d.select(F.col("id").alias("document_id"), "title"), "document_id", "left")
    key = F.sha2(F.concat(F.lit("Title: "), blank("title"), F.lit("\nSection: "), blank("heading"), F.lit("\nPassage: "), blank("text")), 256)
    return t.select("id", "research_job_id", key.alias("passage_key")).groupBy("research_job_id", "passage_key").agg(F.min("id").alias("first_id"), F.count("*").alias("passages"))


@query("""
SELECT j.id, count(p.id) FILTER (WHERE p.error_message IS NULL OR p.error_message <> 'max_pages reached') AS attempted, round(count(p.id) FILTER (WHERE p.error_message IS NULL OR p.error_message <> 'max_pages reached') / j.max_pages, 6) AS budget_used
FROM crawl_jobs j LEFT JOIN crawled_pages p ON p.crawl_job_id = j.id GROUP BY j.id, j.max_pages""")
def attempted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that count against a job's budget: all but those it left out because the budget was used up."""
    jobs, pages = tables(spark, sf_dir, "crawl_jobs", "crawled_pages")
    tried = pages.where("error_message IS NULL OR error_message <> 'max_pages reached'").groupBy(F.col("crawl_job_id").alias("id")).agg(F.count("*").alias("attempted"))
    return jobs.select("id", "max_pages").join(tried, "id", "left").fillna(0, ["attempted"]).select("id", "attempted", F.round(F.col("attempted") / F.col("max_pages"), 6).alias("budget_used"))


@query("""
WITH r AS (SELECT crawl_job_id, id, source_page_id, normalized_target_url AS url, anchor_text, row_number() OVER (PARTITION BY crawl_job_id, source_page_id ORDER BY id) AS rank FROM discovered_links WHERE normalized_target_url IS NOT NULL)
SELECT crawl_job_id, url, min(rank) AS best_rank, min_by(coalesce(anchor_text, ''), id) AS title, min(id) AS first_id, count(DISTINCT source_page_id) AS lists FROM r GROUP BY ALL""")
def result_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked lists of a job united by URL: the first occurrence supplies the title, the best rank counts. Each page's links are a list."""
    links = table(spark, sf_dir, "discovered_links").where("normalized_target_url IS NOT NULL").select("crawl_job_id", "id", "source_page_id", F.col("normalized_target_url").alias("url"), "anchor_text")
    return crawl.unite_results(links, ["crawl_job_id"], "source_page_id")


@query(r"""
SELECT lower(trim(regexp_replace(research_query, '\s+', ' ', 'g'))) AS query_key, min(id) AS first_job, count(*) AS jobs FROM crawl_jobs WHERE research_query IS NOT NULL GROUP BY 1""")
def query_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that differ in case and white space alone are one; all their jobs stay linked to it."""
    q = table(spark, sf_dir, "crawl_jobs").where("research_query IS NOT NULL")
    return q.groupBy(T.query_key(F.col("research_query")).alias("query_key")).agg(F.min("id").alias("first_job"), F.count("*").alias("jobs"))


@query("""
WITH c AS (SELECT crawl_job_id, normalized_target_url AS url, count(*) AS links FROM discovered_links WHERE normalized_target_url IS NOT NULL GROUP BY ALL)
SELECT crawl_job_id, url, links FROM c WHERE NOT EXISTS (SELECT 1 FROM crawled_pages p WHERE p.normalized_url = c.url) AND NOT EXISTS (SELECT 1 FROM discovered_links s WHERE s.selected_for_crawl AND s.crawl_job_id = c.crawl_job_id AND s.normalized_target_url = c.url)""")
def fresh_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of a job that nobody has crawled and the job has not selected yet."""
    links, pages = tables(spark, sf_dir, "discovered_links", "crawled_pages")
    links = links.where("normalized_target_url IS NOT NULL").select("crawl_job_id", F.col("normalized_target_url").alias("url"), "selected_for_crawl")
    # the job's own selection falls to one aggregate, whatever the number of links to one target
    c = links.groupBy("crawl_job_id", "url").agg(F.count("*").alias("links"), F.bool_or(F.coalesce("selected_for_crawl", F.lit(False))).alias("chosen")).where("NOT chosen").drop("chosen")
    return dedup.absent(c, pages.where("normalized_url IS NOT NULL").select(F.col("normalized_url").alias("url")).distinct(), ["url"]).select("crawl_job_id", "url", "links")


@query(rf"""
WITH s AS (SELECT crawl_job_id, normalized_target_url AS url, round(coalesce(max(relevance_score), 0), 9) AS score FROM discovered_links WHERE normalized_target_url IS NOT NULL GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY crawl_job_id, {_HOST.format('url')} ORDER BY score DESC, url) <= 2 AS fits FROM s),
b AS (SELECT *, coalesce(sum(fits::INT) OVER (PARTITION BY crawl_job_id ORDER BY score DESC, url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT crawl_job_id, url, CASE WHEN before >= 10 THEN 'SEED_LIMIT' WHEN NOT fits THEN 'DOMAIN_CAP' ELSE 'SELECTED' END AS outcome FROM b""")
def seed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of a job with why it is not a seed: ten are taken, two of one host."""
    links = table(spark, sf_dir, "discovered_links").where("normalized_target_url IS NOT NULL")
    s = links.groupBy("crawl_job_id", F.col("normalized_target_url").alias("url")).agg(F.round(F.coalesce(F.max("relevance_score"), F.lit(0.0)), 9).alias("score"))
    return crawl.seed_outcomes(s.withColumn("host", U.hostname(F.col("url"))), "crawl_job_id", 2, 10).select("crawl_job_id", "url", "outcome")


@query("SELECT id, round(relevance_score - 0.05 * target_depth, 6) AS priority FROM discovered_links WHERE relevance_score IS NOT NULL")
def link_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "discovered_links").where("relevance_score IS NOT NULL").select("id", F.round(scoring.priority(F.col("relevance_score"), F.col("target_depth")), 6).alias("priority"))


@query(rf"""
WITH j AS (SELECT id AS crawl_job_id, start_url, {_HOST.format('start_url')} AS root, from_json(allowed_domains, '["VARCHAR"]') AS allowed, max_depth, min_relevance_score, crawl_mode FROM crawl_jobs),
l AS (SELECT *, normalized_target_url AS u, {_HOST.format('normalized_target_url')} AS host, row_number() OVER (PARTITION BY crawl_job_id, normalized_target_url ORDER BY id) AS rn FROM discovered_links)
SELECT l.id, CASE WHEN u IS NULL THEN 'INVALID_URL' WHEN rn > 1 OR u = start_url THEN 'DUPLICATE_URL' WHEN target_depth > max_depth THEN 'DEPTH_LIMIT'
  WHEN host = 'localhost' OR host LIKE '%.localhost' OR regexp_matches(host, '^(0|10|127)\.\d+\.\d+\.\d+$|^192\.168\.\d+\.\d+$') THEN 'SSRF_BLOCKED' WHEN host IS DISTINCT FROM root THEN 'EXTERNAL_DOMAIN_DISABLED'
  WHEN len(allowed) > 0 AND NOT list_contains(allowed, host) THEN 'DOMAIN_NOT_ALLOWED' WHEN crawl_mode = 'intelligent' AND relevance_score < min_relevance_score THEN 'LOW_RELEVANCE' ELSE 'SCHEDULED' END AS outcome
FROM l JOIN j USING (crawl_job_id)""")
def schedule_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain of rules a link passes before it is scheduled, by the job's own scope."""
    return crawl.schedule_outcomes(table(spark, sf_dir, "discovered_links"), table(spark, sf_dir, "crawl_jobs"))


@query(rf"""
WITH j AS (SELECT id AS crawl_job_id, {_HOST.format('start_url')} AS root, from_json(allowed_domains, '["VARCHAR"]') AS allowed FROM crawl_jobs), p AS (SELECT crawl_job_id, {_HOST.format('coalesce(final_url, url)')} AS host FROM crawled_pages)
SELECT crawl_job_id, count(*) AS pages, count(*) FILTER (WHERE host = root AND (len(allowed) = 0 OR list_contains(allowed, host))) AS in_scope FROM p JOIN j USING (crawl_job_id) GROUP BY ALL""")
def pages_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a job's pages ended up after redirects, against its scope."""
    pages, jobs = tables(spark, sf_dir, "crawled_pages", "crawl_jobs")
    p = pages.select("crawl_job_id", U.hostname(F.coalesce("final_url", "url")).alias("host")).groupBy("crawl_job_id", "host").agg(F.count("*").alias("n"))
    inside = crawl.in_scope(F.col("host"), F.col("root"), F.col("allowed"))
    j = p.join(crawl.scopes(jobs), "crawl_job_id")
    return j.groupBy("crawl_job_id").agg(F.sum("n").alias("pages"), F.sum(F.when(F.coalesce(inside, F.lit(False)), F.col("n")).otherwise(0)).alias("in_scope"))


@query("SELECT normalized_target_url AS url, min(crawl_job_id) AS crawled_by, count(DISTINCT crawl_job_id) AS jobs FROM discovered_links WHERE selected_for_crawl AND normalized_target_url IS NOT NULL GROUP BY 1")
def shared_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target that several jobs selected is crawled once, by the first, for all."""
    s = table(spark, sf_dir, "discovered_links").where("selected_for_crawl AND normalized_target_url IS NOT NULL")
    return s.groupBy(F.col("normalized_target_url").alias("url")).agg(F.min("crawl_job_id").alias("crawled_by"), F.count_distinct("crawl_job_id").alias("jobs"))


@query("""
SELECT p.id, d.id AS document_id, CASE WHEN d.id IS NOT NULL THEN d.index_status WHEN p.duplicate_of_page_id IS NOT NULL THEN 'DUPLICATE' WHEN p.crawl_status <> 'COMPLETED' THEN 'NOT_CRAWLED' WHEN length(trim(coalesce(p.text_content, ''))) = 0 THEN 'BLANK' ELSE 'NOT_INDEXED' END AS outcome
FROM crawled_pages p LEFT JOIN knowledge_documents d ON d.crawled_page_id = p.id""")
def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What indexing made of each page, with the document that stands for it."""
    pages, docs = tables(spark, sf_dir, "crawled_pages", "knowledge_documents")
    p = pages.select("id", "duplicate_of_page_id", "crawl_status", (F.length(F.trim(F.coalesce("text_content", F.lit("")))) == 0).alias("blank"))
    j = p.join(docs.select(F.col("crawled_page_id").alias("id"), F.col("id").alias("document_id"), "index_status"), "id", "left")
    outcome = F.when(F.col("document_id").isNotNull(), F.col("index_status")).when(F.col("duplicate_of_page_id").isNotNull(), "DUPLICATE").when(F.col("crawl_status") != "COMPLETED", "NOT_CRAWLED").when(F.col("blank"), "BLANK").otherwise("NOT_INDEXED")
    return j.select("id", "document_id", outcome.alias("outcome"))


@query("""
SELECT l.id, l.crawl_job_id, j.crawl_mode, p.title AS source_title, l.anchor_text, l.relevance_score FROM discovered_links l JOIN crawled_pages p ON p.id = l.source_page_id JOIN crawl_jobs j ON j.id = l.crawl_job_id WHERE l.selected_for_crawl""")
def selected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected links with the page they stand on and the mode of their job."""
    links, pages, jobs = tables(spark, sf_dir, "discovered_links", "crawled_pages", "crawl_jobs")
    p, j = pages.select(F.col("id").alias("source_page_id"), F.col("title").alias("source_title")), jobs.select(F.col("id").alias("crawl_job_id"), "crawl_mode")
    return links.where("selected_for_crawl").join(p, "source_page_id").join(j, "crawl_job_id").select("id", "crawl_job_id", "crawl_mode", "source_title", "anchor_text", "relevance_score")


@query("""
SELECT id, index_status, count(*) OVER () AS total FROM knowledge_documents ORDER BY CASE index_status WHEN 'FAILED' THEN 0 WHEN 'RUNNING' THEN 1 WHEN 'PENDING' THEN 2 ELSE 3 END, created_at DESC NULLS LAST, id LIMIT 50 OFFSET 50""")
def documents_by_urgency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a listing in a named order, with the total of all pages."""
    d = table(spark, sf_dir, "knowledge_documents").select("id", "index_status", "created_at")
    s = F.col("index_status")
    urgency = F.when(s == "FAILED", 0).when(s == "RUNNING", 1).when(s == "PENDING", 2).otherwise(3)
    return dedup.page_with_total(d, [urgency, F.col("created_at").desc_nulls_last(), F.col("id")], 50, 50).select("id", "index_status", "total")


@query("""
SELECT crawl_job_id, id, row_number() OVER (PARTITION BY crawl_job_id ORDER BY actual_page_relevance DESC NULLS LAST, predicted_link_relevance DESC NULLS LAST, id) AS position FROM crawled_pages WHERE crawl_job_id IS NOT NULL QUALIFY position <= 30""")
def rerank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thirty pages of a job by their second score, then their first."""
    p = table(spark, sf_dir, "crawled_pages").where("crawl_job_id IS NOT NULL").select("crawl_job_id", "id", "actual_page_relevance", "predicted_link_relevance")
    return top(p, ["crawl_job_id"], [F.col("actual_page_relevance").desc_nulls_last(), F.col("predicted_link_relevance").desc_nulls_last(), "id"], 30, "position").select("crawl_job_id", "id", "position")


@query("""
WITH a AS (SELECT crawl_job_id, id, 0 AS list, row_number() OVER (PARTITION BY crawl_job_id ORDER BY actual_page_relevance DESC, id) AS rank FROM crawled_pages WHERE actual_page_relevance IS NOT NULL QUALIFY rank <= 20),
b AS (SELECT crawl_job_id, id, 1 AS list, row_number() OVER (PARTITION BY crawl_job_id ORDER BY predicted_link_relevance DESC, id) AS rank FROM crawled_pages WHERE predicted_link_relevance IS NOT NULL QUALIFY rank <= 20),
u AS (SELECT crawl_job_id, id, min(list * 1000 + rank) AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
SELECT crawl_job_id, id, row_number() OVER (PARTITION BY crawl_job_id ORDER BY place) AS position FROM u QUALIFY position <= 30""")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked lists of a job, one after the other, each page where it is met first, cut to thirty."""
    p = table(spark, sf_dir, "crawled_pages")
    lists = [top(p.where(F.col(c).isNotNull()).select("crawl_job_id", "id", c), ["crawl_job_id"], [F.col(c).desc(), "id"], 20).select("crawl_job_id", "id", F.lit(n).alias("list"), "rank") for n, c in enumerate(("actual_page_relevance", "predicted_link_relevance"))]
    u = lists[0].unionByName(lists[1]).groupBy("crawl_job_id", "id").agg(F.min(F.struct("list", "rank")).alias("place"))
    return top(u, ["crawl_job_id"], ["place"], 30, "position").select("crawl_job_id", "id", "position")


@query("""
SELECT 'chunk' AS kind, count(*) AS keys FROM (SELECT chunk_id FROM knowledge_chunk_sources UNION SELECT id FROM knowledge_chunks WHERE vector_id IS NOT NULL) UNION ALL
SELECT 'document', count(*) FROM (SELECT document_id FROM knowledge_chunk_sources UNION SELECT document_id FROM knowledge_chunks UNION SELECT id FROM knowledge_documents WHERE index_status = 'COMPLETED')""")
def referenced_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages and documents that any record refers to."""
    chunks, sources, docs = tables(spark, sf_dir, "knowledge_chunks", "knowledge_chunk_sources", "knowledge_documents")
    a = sources.select("chunk_id").union(chunks.where("vector_id IS NOT NULL").select("id")).distinct()
    b = sources.select("document_id").union(chunks.select("document_id")).union(docs.where("index_status = 'COMPLETED'").select("id")).distinct()
    return a.agg(F.count("*").alias("keys")).select(F.lit("chunk").alias("kind"), "keys").unionByName(b.agg(F.count("*").alias("keys")).select(F.lit("document").alias("kind"), "keys"))


@query("""
WITH h AS (SELECT s.document_id, c.heading, min(s.chunk_index) AS place FROM knowledge_chunk_sources s JOIN knowledge_chunks c ON c.id = s.chunk_id WHERE c.heading IS NOT NULL GROUP BY ALL)
SELECT document_id, string_agg(heading, ' / ' ORDER BY place, heading) AS outline FROM h GROUP BY document_id""")
def document_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct headings of each document in the order they are first met; bounded by the document's length."""
    s, c = tables(spark, sf_dir, "knowledge_chunk_sources", "knowledge_chunks")
    h = s.join(c.where("heading IS NOT NULL").select(F.col("id").alias("chunk_id"), "heading"), "chunk_id").groupBy("document_id", "heading").agg(F.min("chunk_index").alias("at"))
    return h.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "heading"))), lambda x: x["heading"]), " / ").alias("outline"))


@query(rf"""
WITH j AS (SELECT id AS crawl_job_id, from_json(allowed_domains, '["VARCHAR"]') AS allowed FROM crawl_jobs), h AS (SELECT DISTINCT crawl_job_id, {_HOST.format('normalized_url')} AS host FROM crawled_pages WHERE normalized_url IS NOT NULL)
SELECT crawl_job_id, count(host) AS hosts, count(*) FILTER (WHERE NOT list_contains(allowed, host)) = 0 AS within FROM h JOIN j USING (crawl_job_id) WHERE len(allowed) > 0 GROUP BY ALL""")
def hosts_within_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the hosts a job met are a subset of those it was allowed."""
    pages, jobs = tables(spark, sf_dir, "crawled_pages", "crawl_jobs")
    h = pages.where("normalized_url IS NOT NULL").select("crawl_job_id", U.hostname(F.col("normalized_url")).alias("host")).distinct()
    j = h.join(crawl.scopes(jobs).where(F.size("allowed") > 0), "crawl_job_id")
    return j.groupBy("crawl_job_id").agg(F.count("host").alias("hosts"), (F.count_if(~F.array_contains("allowed", F.col("host"))) == 0).alias("within"))


@query("SELECT id, substr(sha256(research_job_id || ':' || text_hash), 1, 36) AS group_id FROM knowledge_chunks WHERE research_job_id IS NOT NULL AND text_hash IS NOT NULL")
def group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of 36 characters that depend on their parts alone."""
    c = table(spark, sf_dir, "knowledge_chunks").where("research_job_id IS NOT NULL AND text_hash IS NOT NULL")
    return c.select("id", T.short_id(F.col("research_job_id"), F.col("text_hash")).alias("group_id"))


@query("""
WITH h AS (SELECT research_job_id, sha256(concat_ws('|', CAST(id AS VARCHAR), coalesce(title, ''), coalesce(content_hash, ''), coalesce(index_status, ''))) AS h FROM knowledge_documents),
s AS (SELECT research_job_id, count(*) AS documents, sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS a, sum(CAST('0x' || substr(h, 13, 12) AS BIGINT)) AS b FROM h GROUP BY research_job_id)
SELECT research_job_id, documents, sha256(concat_ws(':', CAST(documents AS VARCHAR), CAST(a AS VARCHAR), CAST(b AS VARCHAR))) AS fingerprint FROM s""")
def job_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a job's documents hold, as one value: equal for equal rows in any order, so a finished run over them can be used again."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    h = table(spark, sf_dir, "knowledge_documents").select("research_job_id", F.sha2(F.concat_ws("|", F.col("id").cast("string"), blank("title"), blank("content_hash"), blank("index_status")), 256).alias("h"))
    part = lambda at: F.sum(F.conv(F.substring("h", at, 12), 16, 10).cast("decimal(38,0)"))
    s = h.groupBy("research_job_id").agg(F.count("*").alias("documents"), part(1).alias("a"), part(13).alias("b"))
    return s.select("research_job_id", "documents", F.sha2(F.concat_ws(":", F.col("documents").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("fingerprint"))


@query("""
WITH a AS (SELECT document_id, list_sort(list(id)) AS s FROM knowledge_chunks GROUP BY 1), b AS (SELECT document_id, list_sort(list(DISTINCT chunk_id)) AS s FROM knowledge_chunk_sources GROUP BY 1)
SELECT count(*) AS documents, round(avg(CASE WHEN a.s = b.s THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM a FULL JOIN b USING (document_id)""")
def passage_set_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For how many documents the passages they own are exactly those that occur in them; sets are held against each other as pairs, none is gathered."""
    a = table(spark, sf_dir, "knowledge_chunks").select("document_id", F.col("id").alias("chunk_id"))
    b = table(spark, sf_dir, "knowledge_chunk_sources").select("document_id", "chunk_id").distinct()
    return evaluate.set_accuracy(a, b, "document_id", "chunk_id").select(F.col("sets").alias("documents"), "accuracy")


@query("""
SELECT crawl_job_id, selected_for_crawl AS selected, count(*) AS links, round(count(DISTINCT regexp_extract(normalized_target_url, '^[a-z]+://([^/?#:]*)', 1)) / count(normalized_target_url), 6) AS unique_domains,
  CAST(sum(round(relevance_score * 10000)) AS BIGINT) AS relevance_e4, count(relevance_score) AS scored, min(relevance_score) AS least, max(relevance_score) AS most FROM discovered_links WHERE normalized_target_url IS NOT NULL GROUP BY ALL""")
def seed_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected links against the others: how relevant (the sum in ten-thousandths, which is exact), and from how many domains."""
    links = table(spark, sf_dir, "discovered_links").where("normalized_target_url IS NOT NULL")
    host = F.regexp_extract("normalized_target_url", "^[a-z]+://([^/?#:]*)", 1)
    return links.groupBy("crawl_job_id", F.col("selected_for_crawl").alias("selected")).agg(F.count("*").alias("links"), F.round(F.count_distinct(host) / F.count("*"), 6).alias("unique_domains"), F.sum(F.round(F.col("relevance_score") * 10000).cast("long")).alias("relevance_e4"), F.count("relevance_score").alias("scored"), F.min("relevance_score").alias("least"), F.max("relevance_score").alias("most"))


@query("""
SELECT crawl_job_id, count(*) AS pages, round(avg(CAST(content_hash IS NOT NULL AS INT)), 6) AS hashed, round(avg(CAST(title IS NOT NULL AS INT)), 6) AS titled, round(avg(CAST(status_code = 200 AS INT)), 6) AS answered FROM crawled_pages GROUP BY crawl_job_id""")
def valid_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of what holds of a job's pages; null where nothing is known."""
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return table(spark, sf_dir, "crawled_pages").groupBy("crawl_job_id").agg(F.count("*").alias("pages"), rate(F.col("content_hash").isNotNull()).alias("hashed"), rate(F.col("title").isNotNull()).alias("titled"), rate(F.col("status_code") == 200).alias("answered"))


@query("""
SELECT p.id, 1 + count(q.id) AS position FROM crawled_pages p LEFT JOIN crawled_pages q ON q.crawl_job_id = p.crawl_job_id AND (q.discovery_order, q.id) < (p.discovery_order, p.id) WHERE p.crawl_job_id IS NOT NULL AND p.discovery_order IS NOT NULL GROUP BY p.id""")
def crawl_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each page in the order its job discovered it, also in a job of very many pages."""
    p = table(spark, sf_dir, "crawled_pages").where("crawl_job_id IS NOT NULL AND discovery_order IS NOT NULL").select("crawl_job_id", "id", "discovery_order")
    return positions(p, ["crawl_job_id"], F.floor(F.col("discovery_order") / 4096), ["discovery_order", "id"], "position").select("id", "position")


@query(rf"""
WITH l AS (SELECT crawl_job_id, normalized_target_url AS url, {_HOST.format('normalized_target_url')} AS host, selected_for_crawl AS chosen, relevance_score FROM discovered_links WHERE normalized_target_url IS NOT NULL),
b AS (SELECT crawl_job_id, host, count(DISTINCT url) AS taken FROM l WHERE chosen GROUP BY ALL), s AS (SELECT crawl_job_id, url, any_value(host) AS host, round(coalesce(max(relevance_score), 0), 9) AS score FROM l GROUP BY crawl_job_id, url HAVING NOT bool_or(coalesce(chosen, false))),
d AS (SELECT s.*, row_number() OVER (PARTITION BY s.crawl_job_id, s.host ORDER BY score DESC, url) + coalesce(taken, 0) <= 6 AS fits FROM s LEFT JOIN b ON b.crawl_job_id = s.crawl_job_id AND b.host = s.host),
e AS (SELECT *, coalesce(sum(fits::INT) OVER (PARTITION BY crawl_job_id ORDER BY score DESC, url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT crawl_job_id, url, CASE WHEN before >= 5 THEN 'SEED_LIMIT' WHEN NOT fits THEN 'DOMAIN_CAP' ELSE 'SELECTED' END AS outcome FROM e""")
def next_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A further round: five more seeds a job of what it has not selected, six of one host in all, counting those it has."""
    links = table(spark, sf_dir, "discovered_links").where("normalized_target_url IS NOT NULL").select("crawl_job_id", F.col("normalized_target_url").alias("url"), F.coalesce("selected_for_crawl", F.lit(False)).alias("chosen"), "relevance_score")
    s = links.groupBy("crawl_job_id", "url").agg(F.bool_or("chosen").alias("chosen"), F.round(F.coalesce(F.max("relevance_score"), F.lit(0.0)), 9).alias("score")).withColumn("host", U.hostname(F.col("url")))
    before = s.where("chosen").groupBy("crawl_job_id", "host").agg(F.count("*").alias("taken"))
    return crawl.seed_outcomes(s.where("NOT chosen").drop("chosen"), "crawl_job_id", 6, 5, before).select("crawl_job_id", "url", "outcome")
