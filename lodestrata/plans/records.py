"""Further queries over records: copies, durations, status tables, scopes, citations, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import text as T
from lodestrata.operators import dedup, evidence, retrieval
from lodestrata.plans.graph import _EDGES, _NODES, _graph
from lodestrata.plans.registry import query
from lodestrata.sources.tables import table, tables


@query("""
WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL), c AS (SELECT h, min(doc_id) AS class_id, count(*) AS copies FROM h GROUP BY h)
SELECT doc_id, class_id, copies FROM h JOIN c USING (h)""")
def document_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document with the first of its exact copies and their number."""
    h = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"))
    classes = h.groupBy("h").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")).withColumn("_n", F.col("copies"))
    return dedup.attach(h, classes, ["h"], "_n").select("doc_id", "class_id", "copies")


@query("""
SELECT j.id, date_sub('millisecond', j.started_at, j.completed_at) AS run_ms, date_sub('millisecond', j.created_at, j.started_at) AS waited_ms, count(p.id) AS pages FROM crawl_jobs j LEFT JOIN crawled_pages p ON p.crawl_job_id = j.id GROUP BY ALL""")
def job_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open jobs have no duration."""
    jobs, pages = tables(spark, sf_dir, "crawl_jobs", "crawled_pages")
    n = pages.groupBy(F.col("crawl_job_id").alias("id")).agg(F.count("*").alias("pages"))
    ms = lambda a, b: F.timestamp_diff("MILLISECOND", F.col(a), F.col(b))
    return jobs.select("id", ms("started_at", "completed_at").alias("run_ms"), ms("created_at", "started_at").alias("waited_ms")).join(n, "id", "left").fillna(0, ["pages"])


@query("""
SELECT research_job_id, count(*) FILTER (WHERE index_status ILIKE 'completed') AS completed, count(*) FILTER (WHERE index_status ILIKE 'failed') AS failed, count(*) FILTER (WHERE index_status NOT ILIKE 'completed' AND index_status NOT ILIKE 'failed') AS other,
  CASE WHEN count(*) FILTER (WHERE index_status ILIKE 'failed') = count(*) THEN 'FAILED' WHEN count(*) FILTER (WHERE index_status ILIKE 'completed') = count(*) THEN 'COMPLETED' ELSE 'PARTIAL' END AS status FROM knowledge_documents GROUP BY research_job_id""")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.lower("index_status")
    a = table(spark, sf_dir, "knowledge_documents").groupBy("research_job_id").agg(F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"), F.count_if(~s.isin("completed", "failed")).alias("other"), F.count("*").alias("n"))
    return a.select("research_job_id", "completed", "failed", "other", F.when(F.col("failed") == F.col("n"), "FAILED").when(F.col("completed") == F.col("n"), "COMPLETED").otherwise("PARTIAL").alias("status"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_discount AS e, l_tax AS n, l_quantity / 500 AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN e >= n AND e >= c THEN 'ENTAILMENT' WHEN n >= c THEN 'NEUTRAL' ELSE 'CONTRADICTION' END AS label,
  round(greatest(e, n, c) - (e + n + c - greatest(e, n, c) - least(e, n, c)), 6) < 0.01 AS ambiguous FROM s""")
def relation_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of the highest of three scores, and whether the second comes close."""
    e, n, c = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 500
    label = F.when((e >= n) & (e >= c), "ENTAILMENT").when(n >= c, "NEUTRAL").otherwise("CONTRADICTION")
    top = F.greatest(e, n, c)
    second = e + n + c - top - F.least(e, n, c)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", label.alias("label"), (F.round(top - second, 6) < 0.01).alias("ambiguous"))


@query("""
WITH s AS (SELECT s.id, s.document_id, s.chunk_index, greatest(coalesce(c.token_count, 0), 0) AS t FROM knowledge_chunk_sources s JOIN knowledge_chunks c ON c.id = s.chunk_id),
n AS (SELECT a.id, a.t AS own, b.id AS nb, b.chunk_index, b.t FROM s a JOIN s b ON a.document_id = b.document_id AND abs(b.chunk_index - a.chunk_index) = 1),
o AS (SELECT *, coalesce(sum(t) FILTER (WHERE t <= 700 - own) OVER (PARTITION BY id ORDER BY chunk_index, nb ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT id, nb AS neighbour_id FROM o WHERE t <= 700 - own - before""")
def neighbour_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours that still fit a budget of 700 tokens beside the passage itself, in order; one that does not fit is passed over."""
    sources, chunks = tables(spark, sf_dir, "knowledge_chunk_sources", "knowledge_chunks")
    sized = sources.join(chunks.select(F.col("id").alias("chunk_id"), F.greatest(F.coalesce("token_count", F.lit(0)), F.lit(0)).alias("t")), "chunk_id").select("id", "document_id", "chunk_index", "t")
    pairs = retrieval.neighbours(sized).where("distance <> 0")
    own, theirs = sized.select("id", F.col("t").alias("own")), sized.select(F.col("id").alias("neighbour_id"), "t", "chunk_index")
    around = pairs.join(own, "id").join(theirs, "neighbour_id").groupBy("id", "own").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "neighbour_id", "t"))).alias("near"))  # a few for each window
    start = F.struct((700 - F.col("own")).cast("int").alias("left"), F.array().cast("array<bigint>").alias("kept"))
    fold = F.aggregate("near", start, lambda a, x: F.when(x["t"] <= a["left"], F.struct((a["left"] - x["t"]).cast("int").alias("left"), F.concat(a["kept"], F.array(x["neighbour_id"])).alias("kept"))).otherwise(a), lambda a: a["kept"])
    return around.select("id", F.explode(fold).alias("neighbour_id"))


_SCOPE = "list_distinct(list_transform(regexp_extract_all(lower({0}), '{1}'), lambda x: rtrim(x, '.,;:!?')))"
_SCOPES = {"y": r"\b(?:19|20)\d{2}\b", "d": r"\bdataset\s+[\p{L}\p{N}_.-]+", "v": r"\bversion\s+[\p{L}\p{N}_.-]+"}
_APART = "(len({0}a) > 0 AND len({0}b) > 0 AND NOT list_has_any({0}a, {0}b))"


@query(f"""
WITH m AS (SELECT c.id, coalesce(d.title, '') AS a, c.text AS b FROM knowledge_chunks c JOIN knowledge_documents d ON d.id = c.document_id WHERE c.text IS NOT NULL),
s AS (SELECT id, {', '.join(f"{_SCOPE.format(t, pattern)} AS {n}{t}" for n, pattern in _SCOPES.items() for t in 'ab')} FROM m)
SELECT id, {' OR '.join(_APART.format(n) for n in _SCOPES)} AS mismatch, len(yb) AS years, len(db) AS datasets, len(vb) AS versions FROM s""")
def scope_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a passage and the title of its document name years, data sets or versions, and none in common."""
    chunks, docs = tables(spark, sf_dir, "knowledge_chunks", "knowledge_documents")
    j = chunks.where("text IS NOT NULL").join(docs.select(F.col("id").alias("document_id"), F.coalesce("title", F.lit("")).alias("title")), "document_id")
    size = lambda p: F.size(T.marks(F.col("text"), p))
    return j.select("id", evidence.scope_mismatch(F.col("title"), F.col("text")).alias("mismatch"), size(T.YEAR).alias("years"), size(T.DATASET).alias("datasets"), size(T.VERSION).alias("versions"))


@query()
def mergeable_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a job whose titles share their first three words: may a title and the first of its kind be held for the same statement?"""
    d = table(spark, sf_dir, "knowledge_documents").where("title IS NOT NULL AND research_job_id IS NOT NULL")
    key = F.concat_ws(" ", F.slice(F.split(T.normalize_claim(F.col("title")), " "), 1, 3))
    k = d.select("id", "research_job_id", "title", key.alias("begin"))
    first = k.groupBy("research_job_id", "begin").agg(F.min_by("title", "id").alias("first_title"), F.min("id").alias("first_id"), F.count("*").alias("_n"))
    j = dedup.attach(k, first, ["research_job_id", "begin"], "_n").where("id <> first_id")
    return j.select("id", "first_id", evidence.safe_to_merge(F.col("title"), F.col("first_title")).alias("mergeable"))


@query()
def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of sentences hold what they quote; the same spans moved by one character do not."""
    chunks = table(spark, sf_dir, "knowledge_chunks").select("id", "text")
    s = evidence.sentence_spans(chunks, id_col="id", text_col="text").join(chunks, "id")
    exact = F.substring("text", F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    right = evidence.valid_citation(F.col("text"), F.col("start_offset"), F.col("end_offset"), exact)
    moved = evidence.valid_citation(F.col("text"), F.col("start_offset") + 1, F.col("end_offset") + 1, exact)
    return s.groupBy(right.alias("right"), moved.alias("moved")).agg(F.count("*").alias("spans"))


@query("SELECT source_domain, count(*) AS documents, string_agg(DISTINCT research_job_id, ',' ORDER BY research_job_id) AS jobs FROM knowledge_documents WHERE source_domain IS NOT NULL GROUP BY source_domain")
def domain_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The research jobs, of which there are few, that drew on each domain."""
    d = table(spark, sf_dir, "knowledge_documents").where("source_domain IS NOT NULL")
    return d.groupBy("source_domain").agg(F.count("*").alias("documents"), F.array_join(F.array_sort(F.collect_set("research_job_id")), ",").alias("jobs"))


@query(f"""
WITH {_NODES}, {_EDGES}
SELECT node_id AS id, CAST(to_json({{'node_id': node_id, 'node_type': node_type, 'label': label}}) AS VARCHAR) AS json FROM nodes
UNION ALL SELECT edge_id, CAST(to_json({{'edge_id': edge_id, 'edge_type': edge_type, 'src': src, 'dst': dst}}) AS VARCHAR) FROM edges""")
def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON text for each node and edge, null fields kept."""
    n, e = _graph(spark, sf_dir)
    text = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"}).alias("json")
    return n.select(F.col("node_id").alias("id"), text("node_id", "node_type", "label")).unionByName(e.select(F.col("edge_id").alias("id"), text("edge_id", "edge_type", "src", "dst")))


@query()
def sentence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence of a passage with the one after it, as one span: what may be cited of two sentences."""
    s = evidence.sentence_spans(table(spark, sf_dir, "knowledge_chunks"), id_col="id", text_col="text")
    w = Window.partitionBy("id").orderBy("sentence_no")
    return s.select("id", "sentence_no", "start_offset", F.lead("end_offset").over(w).alias("end_offset")).where("end_offset IS NOT NULL")


@query(r"""
WITH t AS (SELECT id, regexp_extract_all(lower(title), '[\p{L}\p{N}_]+(?:[-.][\p{L}\p{N}_]+)*')[1:32] AS l FROM knowledge_documents WHERE title IS NOT NULL)
SELECT id, array_to_string(list_transform(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x: chr(34) || x || chr(34)), ' OR ') AS lexical_query FROM t""")
def lexical_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted tokens of each title, joined by OR: order kept, repeats dropped."""
    quoted = F.transform(F.array_distinct(F.slice(T.tokens(F.col("title")), 1, 32)), lambda t: F.concat(F.lit('"'), t, F.lit('"')))
    return table(spark, sf_dir, "knowledge_documents").where("title IS NOT NULL").select("id", F.array_join(quoted, " OR ").alias("lexical_query"))


@query("SELECT id FROM crawled_pages p WHERE crawl_status = 'COMPLETED' AND duplicate_of_page_id IS NULL AND length(trim(coalesce(text_content, ''))) > 0 AND NOT EXISTS (SELECT 1 FROM knowledge_documents d WHERE d.crawled_page_id = p.id)")
def pages_to_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible pages that no document stands for yet: what an idempotent insert would add."""
    pages, docs = tables(spark, sf_dir, "crawled_pages", "knowledge_documents")
    eligible = pages.where("crawl_status = 'COMPLETED' AND duplicate_of_page_id IS NULL AND length(trim(coalesce(text_content, ''))) > 0").select("id")
    return dedup.absent(eligible, docs.select(F.col("crawled_page_id").alias("id")), ["id"])


_CLAIMS = f"""
WITH t AS (SELECT id, research_job_id, {T.CLAIM_SQL.format('title')} AS form FROM knowledge_documents WHERE title IS NOT NULL)
SELECT research_job_id, form, min(id) AS kept, count(*) AS members FROM t GROUP BY ALL"""


@query(_CLAIMS)
def claim_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of a job with the same normal form, in any script, are one; the first stands for all."""
    return _claim_groups(table(spark, sf_dir, "knowledge_documents").where("title IS NOT NULL"))


@query(_CLAIMS)
def claim_dedup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claim_dedup(spark, sf_dir)


def _claim_groups(t: DataFrame) -> DataFrame:
    return t.groupBy("research_job_id", T.normalize_claim(F.col("title")).alias("form")).agg(F.min("id").alias("kept"), F.count("*").alias("members"))


@query("SELECT document_id, count(*) AS pieces, string_agg(CAST(chunk_id AS VARCHAR), ' ' ORDER BY chunk_index, id) AS passages FROM knowledge_chunk_sources GROUP BY document_id")
def document_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of each document in order; their number is bounded by the document's length."""
    s = table(spark, sf_dir, "knowledge_chunk_sources")
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "id", "chunk_id")))
    return s.groupBy("document_id").agg(F.count("*").alias("pieces"), F.array_join(F.transform(ordered, lambda x: x["chunk_id"].cast("string")), " ").alias("passages"))


@query("SELECT crawl_job_id, count(*) FILTER (WHERE crawl_status = 'COMPLETED') AS completed, count(*) FILTER (WHERE crawl_status = 'FAILED') AS failed, count(*) FILTER (WHERE crawl_status = 'QUEUED') AS queued, count(*) FILTER (WHERE crawl_status = 'SKIPPED') AS skipped FROM crawled_pages GROUP BY crawl_job_id")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["COMPLETED", "FAILED", "QUEUED", "SKIPPED"]
    p = table(spark, sf_dir, "crawled_pages").groupBy("crawl_job_id").pivot("crawl_status", names).agg(F.count("id"))
    return p.select("crawl_job_id", *[F.coalesce(F.col(n), F.lit(0)).alias(n.lower()) for n in names])


@query("""
WITH g AS (SELECT user_id, event_id, ts, CASE WHEN date_diff('second', lag(ts) OVER w, ts) <= 43200 THEN 0 ELSE 1 END AS starts FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session, ts FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY ALL""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events without a pause of more than twelve hours; Spark's session windows merge them without a sort of a whole user."""
    e = table(spark, sf_dir, "events").where("ts IS NOT NULL")
    # a window is open at its end, so a pause of exactly the gap still belongs to it
    w = F.session_window("ts", "12 hours 1 second")
    s = e.groupBy("user_id", w).agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("first_ts"))
    return s.select("user_id", n.cast("long").alias("session"), "events", "first_ts", "last_ts")


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS events, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("ts IS NOT NULL")
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("hour"), "events", "total")
