"""Queries over passages, documents and the evidence in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import evaluate, evidence, index
from lodestrata.plans.registry import query
from lodestrata.sources.tables import table, tables


_SECTIONS = r"""
WITH b AS (SELECT id, title, list_filter(list_transform(string_split_regex(replace(text_content, chr(13), ''), '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS bs FROM crawled_pages WHERE length(text_content) > 0),
e AS (SELECT id, title, i - 1 AS block_no, bs[i] AS t FROM (SELECT id, title, bs, unnest(range(1, len(bs) + 1)) AS i FROM b)),
h AS (SELECT *, CASE WHEN NOT contains(t, chr(10)) AND regexp_matches(t, '^##? ') OR contains(t, chr(10)) AND starts_with(t, '# ') THEN trim(ltrim(regexp_extract(t, '^[^\n]*'), '# ')) END AS own,
  CASE WHEN NOT contains(t, chr(10)) AND regexp_matches(t, '^##? ') THEN '' WHEN contains(t, chr(10)) AND starts_with(t, '# ') THEN regexp_replace(regexp_replace(t, '^[^\n]*\n', ''), '^\s+', '') ELSE t END AS body FROM e)
SELECT id, CAST(block_no AS INT) AS block_no, heading, body FROM (SELECT id, block_no, body, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY id ORDER BY block_no), title, '') AS heading FROM h) WHERE body <> ''"""


@query(_SECTIONS)
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.sections(table(spark, sf_dir, "crawled_pages"), id_col="id", text_col="text_content", title_col="title")


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.chunks(table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text", title_col="title")


@query("SELECT research_job_id, text_hash, min(id) AS canonical_id, count(*) AS occurrences FROM knowledge_chunks GROUP BY ALL")
def canonical_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.canonical(table(spark, sf_dir, "knowledge_chunks"), "research_job_id")


@query(r"""
WITH h AS (SELECT id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(research_job_id || ':' || text_hash)) AS h FROM knowledge_chunks)
SELECT id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', h[17:17]) - 1) % 4, 1) || h[18:20] || '-' || h[21:32] AS vector_key FROM h""")
def vector_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.vector_ids(table(spark, sf_dir, "knowledge_chunks"), "research_job_id")


@query("""
WITH o AS (SELECT crawled_page_id AS key, min(content_hash) AS hash FROM knowledge_documents WHERE crawled_page_id IS NOT NULL AND content_hash IS NOT NULL GROUP BY 1),
n AS (SELECT id AS key, content_hash AS hash FROM crawled_pages WHERE content_hash IS NOT NULL AND duplicate_of_page_id IS NULL)
SELECT key, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' WHEN o.hash <> n.hash THEN 'changed' ELSE 'skipped' END AS action FROM o FULL JOIN n USING (key)""")
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = tables(spark, sf_dir, "knowledge_documents", "crawled_pages")
    old = docs.where("crawled_page_id IS NOT NULL AND content_hash IS NOT NULL").groupBy(F.col("crawled_page_id").alias("key")).agg(F.min("content_hash").alias("hash"))
    new = pages.where("content_hash IS NOT NULL AND duplicate_of_page_id IS NULL").select(F.col("id").alias("key"), F.col("content_hash").alias("hash"))
    return index.incremental(old, new)


@query("SELECT id FROM knowledge_chunks c WHERE NOT EXISTS (SELECT 1 FROM knowledge_chunk_sources s JOIN knowledge_documents d ON d.id = s.document_id WHERE s.chunk_id = c.id AND d.index_status = 'COMPLETED')")
def orphan_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that no finished document holds."""
    chunks, sources, docs = tables(spark, sf_dir, "knowledge_chunks", "knowledge_chunk_sources", "knowledge_documents")
    return index.orphans(chunks, sources.join(docs.where("index_status = 'COMPLETED'").select(F.col("id").alias("document_id")), "document_id", "left_semi"))


@query("""
WITH s AS (SELECT s.* FROM knowledge_chunk_sources s JOIN knowledge_documents d ON d.id = s.document_id WHERE d.index_status = 'COMPLETED'),
lost AS (SELECT id FROM knowledge_chunks c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.chunk_id = c.id AND s.document_id = c.document_id))
SELECT lost.id, s.document_id, s.id AS source_id FROM lost JOIN s ON s.chunk_id = lost.id QUALIFY row_number() OVER (PARTITION BY lost.id ORDER BY s.id) = 1""")
def survivor_rehome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages whose own document is not finished, with the first finished one that holds them."""
    chunks, sources, docs = tables(spark, sf_dir, "knowledge_chunks", "knowledge_chunk_sources", "knowledge_documents")
    return index.rehomed(chunks, sources.join(docs.where("index_status = 'COMPLETED'").select(F.col("id").alias("document_id")), "document_id", "left_semi"))


@query("""
WITH s AS (SELECT s.* FROM knowledge_chunk_sources s JOIN knowledge_documents d ON d.id = s.document_id WHERE d.index_status <> 'FAILED'),
f AS (SELECT chunk_id, document_id, id AS source_id FROM s QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY id) = 1)
SELECT c.id, CASE WHEN f.chunk_id IS NULL THEN 'pruned' WHEN EXISTS (SELECT 1 FROM s WHERE s.chunk_id = c.id AND s.document_id = c.document_id) THEN 'kept' ELSE 'rehomed' END AS action,
  CASE WHEN f.chunk_id IS NULL OR EXISTS (SELECT 1 FROM s WHERE s.chunk_id = c.id AND s.document_id = c.document_id) THEN NULL ELSE f.document_id END AS new_document_id FROM knowledge_chunks c LEFT JOIN f ON f.chunk_id = c.id""")
def index_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each passage once the documents that failed are taken out: kept, moved to another document, or pruned."""
    chunks, sources, docs = tables(spark, sf_dir, "knowledge_chunks", "knowledge_chunk_sources", "knowledge_documents")
    return index.upkeep(chunks, sources, docs.where("index_status = 'FAILED'").select(F.col("id").alias("document_id")))


@query("""
SELECT 'passage without occurrence' AS issue, count(*) AS n FROM knowledge_chunks c WHERE NOT EXISTS (SELECT 1 FROM knowledge_chunk_sources s WHERE s.chunk_id = c.id)
UNION ALL SELECT 'occurrence without passage', count(*) FROM knowledge_chunk_sources s WHERE NOT EXISTS (SELECT 1 FROM knowledge_chunks c WHERE c.id = s.chunk_id)
UNION ALL SELECT 'occurrence without document', count(*) FROM knowledge_chunk_sources s WHERE NOT EXISTS (SELECT 1 FROM knowledge_documents d WHERE d.id = s.document_id)
UNION ALL SELECT 'passage without vector', count(*) FROM knowledge_chunks WHERE vector_id IS NULL
UNION ALL SELECT 'repeated position', count(*) FROM (SELECT 1 FROM knowledge_chunk_sources GROUP BY document_id, chunk_index HAVING count(*) > 1)""")
def index_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.audit(*tables(spark, sf_dir, "knowledge_chunks", "knowledge_chunk_sources", "knowledge_documents"))


@query("SELECT document_id, count(*) FILTER (WHERE step > 1) AS gaps FROM (SELECT document_id, chunk_index - lag(chunk_index) OVER (PARTITION BY document_id ORDER BY chunk_index) AS step FROM knowledge_chunk_sources) GROUP BY document_id")
def left_out_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.adjacent(table(spark, sf_dir, "knowledge_chunk_sources"))


@query("SELECT research_job_id, count(*) AS passages, round(avg(token_count), 6) AS mean_tokens, median(token_count) AS median_tokens, max(token_count) AS most_tokens FROM knowledge_chunks GROUP BY research_job_id")
def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "knowledge_chunks").select("research_job_id", "token_count")
    d = evaluate.distribution(c, ["research_job_id"], "token_count", width=8)
    n = c.groupBy(F.col("research_job_id").alias("job")).agg(F.count("*").alias("passages"))
    return d.join(n, F.col("research_job_id").eqNullSafe(F.col("job"))).select("research_job_id", "passages", F.col("mean").alias("mean_tokens"), F.col("median").alias("median_tokens"), F.col("most").alias("most_tokens"))


@query(r"""
WITH RECURSIVE k AS (SELECT id, CASE WHEN regexp_matches(coalesce(canonical_url, source_url), '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN
  'u:' || lower(regexp_extract(coalesce(canonical_url, source_url), '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)', 1)) || '://' || lower(regexp_extract(coalesce(canonical_url, source_url), '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)', 2)) || regexp_replace(regexp_extract(coalesce(canonical_url, source_url), '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)', 3), '/+$', '') END AS key FROM knowledge_documents
  UNION ALL SELECT id, 'h:' || content_hash FROM knowledge_documents), keys AS (SELECT * FROM k WHERE key IS NOT NULL),
pairs AS (SELECT DISTINCT a.id AS x, b.id AS y FROM keys a JOIN keys b USING (key)),
walk AS (SELECT id AS document_id, id AS seen FROM knowledge_documents UNION SELECT document_id, y FROM walk JOIN pairs ON walk.seen = pairs.x)
SELECT document_id, min(seen) AS group_id FROM walk GROUP BY document_id""")
def source_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.source_groups(table(spark, sf_dir, "knowledge_documents"))


@query(r"""
WITH j AS (SELECT c.id, lower(q.question) AS q, lower(c.text) AS t FROM knowledge_chunks c JOIN research_jobs q ON q.id = c.research_job_id WHERE c.text IS NOT NULL AND q.question IS NOT NULL),
w AS (SELECT id, list_distinct(list_filter(regexp_extract_all(q, '[\p{L}\p{N}_%-]+'), lambda x: length(x) > 2)) AS a, list_distinct(list_filter(regexp_extract_all(t, '[\p{L}\p{N}_%-]+'), lambda x: length(x) > 2)) AS b FROM j)
SELECT id, len(a) > 0 AND len(list_intersect(a, b)) >= 0.4 * len(a) AS grounded, round(len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b)))), 6) AS overlap FROM w""")
def grounded_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, jobs = tables(spark, sf_dir, "knowledge_chunks", "research_jobs")
    j = chunks.where("text IS NOT NULL").join(jobs.where("question IS NOT NULL").select(F.col("id").alias("research_job_id"), "question"), "research_job_id")
    a, b = T.claim_terms(F.col("question")), T.claim_terms(F.col("text"))
    return j.select("id", evidence.grounded(F.col("question"), F.col("text")).alias("grounded"), F.round(F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b))), 6).alias("overlap"))


@query(r"SELECT doc_id, regexp_matches(text, '(?i)\b(?:ignore (?:all )?(?:previous|prior) instructions|mark confidence|system prompt|create the claim|reveal (?:secrets?|environment)|execute (?:this|commands?))\b') AS suspicious, list_sort(list_distinct(regexp_extract_all(text, '\b(?:19|20)\d{2}\b'))) AS years FROM documents WHERE text IS NOT NULL")
def suspicious_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", T.suspicious(F.col("text")).alias("suspicious"), T.marks(F.col("text"), T.YEAR).alias("years"))


@query("""
WITH r AS (SELECT l_partkey AS claim, CASE l_returnflag WHEN 'A' THEN 'SUPPORT' WHEN 'R' THEN 'CONTRADICTION' ELSE 'PARTIAL' END AS relation, l_suppkey AS g, l_linenumber % 4 <> 0 AS cited FROM lineitem),
a AS (SELECT claim, count(DISTINCT g) FILTER (WHERE relation = 'SUPPORT' AND cited) AS supporting, count(DISTINCT g) FILTER (WHERE relation = 'CONTRADICTION' AND cited) AS contradicting, count(*) FILTER (WHERE relation = 'PARTIAL') AS partial,
  count(*) FILTER (WHERE relation IN ('SUPPORT', 'CONTRADICTION') AND NOT cited) AS uncited FROM r GROUP BY claim),
d AS (SELECT *, CASE WHEN supporting > 0 AND contradicting > 0 THEN 'CONTESTED' WHEN uncited > 0 THEN 'INSUFFICIENT' WHEN contradicting > 0 THEN 'CONTRADICTED' WHEN supporting > 1 THEN 'CORROBORATED' WHEN supporting = 1 THEN 'SUPPORTED' WHEN partial > 0 THEN 'PARTIALLY_SUPPORTED' ELSE 'INSUFFICIENT' END AS status FROM a)
SELECT claim, status, CASE WHEN status = 'CORROBORATED' THEN 'HIGH' WHEN status IN ('SUPPORTED', 'CONTRADICTED') THEN 'MEDIUM' WHEN status = 'PARTIALLY_SUPPORTED' THEN 'LOW' ELSE 'UNRESOLVED' END AS confidence, supporting, contradicting FROM d""")
def claim_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items stand for relations: the part is the claim, the supplier the source."""
    relation = F.when(F.col("l_returnflag") == "A", "SUPPORT").when(F.col("l_returnflag") == "R", "CONTRADICTION").otherwise("PARTIAL")
    r = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("claim"), relation.alias("relation"), F.col("l_suppkey").alias("source_group"), (F.col("l_linenumber") % 4 != 0).alias("cited"))
    return evidence.decide(r)


@query()
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.sentence_spans(table(spark, sf_dir, "knowledge_chunks"), id_col="id", text_col="text")


_PRINTS = f"SELECT id, sha256(coalesce(title, '') || chr(10) || coalesce(source_url, '')) AS fingerprint, {T.CLAIM_SQL.format('title')} AS claim_form FROM knowledge_documents"


@query(_PRINTS)
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whatever the script of its title."""
    docs = table(spark, sf_dir, "knowledge_documents")
    return docs.select("id", T.fingerprint(F.col("title"), F.col("source_url")).alias("fingerprint"), T.normalize_claim(F.col("title")).alias("claim_form"))


@query(_PRINTS)
def document_fingerprints_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(spark, sf_dir)
