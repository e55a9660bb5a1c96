"""Queries over passages and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import scoring
from lodestrata.functions import text as T
from lodestrata.operators import dedup, retrieval
from lodestrata.operators.ranking import top
from lodestrata.plans.registry import query
from lodestrata.sources.tables import spread, table

_TOK = r"'[\p{L}\p{N}_]+(?:[-.][\p{L}\p{N}_]+)*'"
_BM25 = rf"""
qt AS (SELECT DISTINCT query_id, grp, unnest(list_distinct(regexp_extract_all(lower(question), {_TOK})[1:32])) AS token FROM (SELECT id AS query_id, id AS grp, question FROM research_jobs)),
ps AS (SELECT id AS passage_id, research_job_id AS grp, document_id, regexp_extract_all(lower(concat_ws(' ', title, title, heading, text)), {_TOK}) AS toks FROM (SELECT c.*, d.title FROM knowledge_chunks c LEFT JOIN knowledge_documents d ON d.id = c.document_id) WHERE research_job_id IS NOT NULL),
sz AS (SELECT grp, count(*) AS n, avg(len(toks)) AS avgl FROM ps GROUP BY grp),
pt AS (SELECT passage_id, grp, len(toks) AS len, unnest(toks) AS token FROM ps),
tf AS (SELECT passage_id, grp, len, token, count(*) AS tf FROM pt GROUP BY ALL),
df AS (SELECT grp, token, count(*) AS df FROM tf GROUP BY ALL),
bm AS (SELECT qt.query_id, tf.passage_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgl))) AS score
  FROM tf JOIN df USING (grp, token) JOIN sz USING (grp) JOIN qt ON qt.grp = tf.grp AND qt.token = tf.token GROUP BY ALL)"""
_DENSE = rf"""
nq AS (SELECT query_id, count(*) AS nq FROM qt GROUP BY query_id),
dn AS (SELECT qt.query_id, ps.passage_id, count(*) / sqrt(any_value(nq.nq) * any_value(len(list_distinct(ps.toks)))) AS similarity
  FROM (SELECT passage_id, grp, toks, unnest(list_distinct(toks)) AS token FROM ps) ps JOIN qt ON qt.grp = ps.grp AND qt.token = ps.token JOIN nq ON nq.query_id = qt.query_id GROUP BY qt.query_id, ps.passage_id)"""


#: How often the words of each field of a passage count.
WEIGHTS = {"title": 2, "heading": 1, "text": 1}


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "knowledge_chunks").where("research_job_id IS NOT NULL")
    titles = table(spark, sf_dir, "knowledge_documents").select(F.col("id").alias("document_id"), "title")
    return spread(chunks.select(F.col("id").alias("passage_id"), F.col("research_job_id").alias("grp"), "document_id", "heading", "text")).join(titles, "document_id", "left")


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = terms(spark, sf_dir)
    return retrieval.lexical_index(passages(spark, sf_dir), t, WEIGHTS), t


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.query_terms(table(spark, sf_dir, "research_jobs"), id_col="id", text_col="question", group_col="id")


@query(f"WITH {_BM25} SELECT query_id, passage_id, round(round(score, 9), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, passage_id) AS rank FROM bm QUALIFY rank <= 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.scored(*_index(spark, sf_dir)).select("query_id", "passage_id", "score")
    return top(found, ["query_id"], [F.col("score").desc(), "passage_id"], 20).withColumn("score", F.round("score", 6))


_SINGLE = """
r AS (SELECT query_id, passage_id, row_number() OVER (PARTITION BY query_id ORDER BY round({0}, 9) DESC, passage_id) AS {1}_rank FROM {2} QUALIFY {1}_rank <= 50),
cp AS (SELECT r.*, round(1.0::DOUBLE / (60 + {1}_rank), 9) AS rrf, ps.document_id, row_number() OVER (PARTITION BY query_id, document_id ORDER BY round(1.0::DOUBLE / (60 + {1}_rank), 9) DESC, passage_id) AS w FROM r JOIN ps USING (passage_id) QUALIFY w <= 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, passage_id) AS position, passage_id, document_id, rrf, {1}_rank FROM cp QUALIFY position <= 8"""


@query(f"WITH {_BM25}, {_SINGLE.format('score', 'lexical', 'bm')}")
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search(*_index(spark, sf_dir), "lexical")


@query(f"WITH {_BM25}, {_DENSE}, {_SINGLE.format('similarity', 'dense', 'dn')}")
def dense_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search(*_index(spark, sf_dir), "dense")


@query(f"""
WITH {_BM25}, {_DENSE},
lx AS (SELECT query_id, passage_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, passage_id) AS lexical_rank FROM bm QUALIFY lexical_rank <= 50),
dx AS (SELECT query_id, passage_id, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, passage_id) AS dense_rank FROM dn QUALIFY dense_rank <= 50),
fu AS (SELECT query_id, passage_id, lexical_rank, dense_rank, round(coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + dense_rank), 0), 9) AS rrf FROM lx FULL JOIN dx USING (query_id, passage_id)),
cp AS (SELECT fu.*, ps.document_id, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rrf DESC, passage_id) AS w FROM fu JOIN ps USING (passage_id) QUALIFY w <= 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, passage_id) AS position, passage_id, document_id, rrf, lexical_rank, dense_rank FROM cp QUALIFY position <= 8""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search(*_index(spark, sf_dir), "hybrid")


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 6) AS similarity FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s QUALIFY rank <= 10""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return retrieval.dense_topk(v, v.where(F.col("vec_id") % 50 == 0), 10, id_col="vec_id", vector_col="embedding")


@query("""
WITH c AS (SELECT label, list_transform(range(1, 65), lambda i: 0) AS z FROM embeddings LIMIT 0), x AS (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(1, 65)) AS i FROM embeddings),
m AS (SELECT label, i, avg(v::DOUBLE) AS c FROM x GROUP BY ALL), d AS (SELECT x.vec_id, x.label, sum(x.v::DOUBLE * m.c) / (sqrt(sum(x.v::DOUBLE * x.v::DOUBLE)) * sqrt(sum(m.c * m.c))) AS s FROM x JOIN m ON m.label = x.label AND m.i = x.i GROUP BY ALL)
SELECT label, count(*) AS vectors, round(avg(s), 6) AS mean_similarity, round(min(s), 6) AS least_similarity FROM d GROUP BY label""")
def label_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How close the vectors of each label lie to their mean."""
    v = table(spark, sf_dir, "embeddings")
    mean = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    centre = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s.getField("c")).alias("centre"))
    s = v.join(centre, "label").select("label", scoring.cosine(F.col("embedding"), F.col("centre")).alias("s"))
    return s.groupBy("label").agg(F.count("*").alias("vectors"), F.round(F.avg("s"), 6).alias("mean_similarity"), F.round(F.min("s"), 6).alias("least_similarity"))


@query("SELECT a.id, b.id AS neighbour_id, b.chunk_index - a.chunk_index AS distance FROM knowledge_chunk_sources a JOIN knowledge_chunk_sources b ON a.document_id = b.document_id AND b.chunk_index BETWEEN a.chunk_index - 1 AND a.chunk_index + 1 AND a.id <> b.id")
def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.neighbours(table(spark, sf_dir, "knowledge_chunk_sources"))


@query("SELECT id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM knowledge_chunk_sources WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index, id)")
def prev_next_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("document_id").orderBy("chunk_index", "id")
    return table(spark, sf_dir, "knowledge_chunk_sources").select("id", F.lag("id").over(w).alias("previous_id"), F.lead("id").over(w).alias("next_id"))


@query("""
SELECT c.id AS chunk_id, s.id AS source_id, d.id AS document_id, d.source_domain, c.token_count FROM knowledge_chunk_sources s JOIN knowledge_chunks c ON c.id = s.chunk_id JOIN knowledge_documents d ON d.id = s.document_id
QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY s.id DESC) = 1""")
def allowed_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each passage: its last occurrence, with the document it stands in."""
    sources = table(spark, sf_dir, "knowledge_chunk_sources").select(F.col("id").alias("source_id"), "chunk_id", "document_id")
    chunks = table(spark, sf_dir, "knowledge_chunks").select(F.col("id").alias("chunk_id"), "token_count")
    docs = table(spark, sf_dir, "knowledge_documents").select(F.col("id").alias("document_id"), "source_domain")
    joined = sources.join(chunks, "chunk_id").join(docs, "document_id")
    return dedup.latest(joined, ["chunk_id"], ["source_id"]).select("chunk_id", "source_id", "document_id", "source_domain", "token_count")


@query("""
SELECT c.id, c.document_id FROM knowledge_chunks c WHERE c.document_id IN (SELECT d.id FROM knowledge_documents d JOIN crawl_jobs j ON d.crawl_job_id = j.id WHERE j.status ILIKE 'completed' AND d.source_domain IS NOT NULL
  AND lower(d.source_domain) IN (SELECT lower(source_domain) FROM knowledge_documents GROUP BY 1 HAVING count(*) >= 3) AND d.crawled_page_id IN (SELECT source_page_id FROM discovered_links WHERE selected_for_crawl))""")
def retrieval_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages whose document passes filters on its job, its domain and its page, before anything is ranked."""
    jobs = table(spark, sf_dir, "crawl_jobs").where(F.lower("status") == "completed").select(F.col("id").alias("crawl_job_id"))
    docs = table(spark, sf_dir, "knowledge_documents").where("source_domain IS NOT NULL").withColumn("domain", F.lower("source_domain"))
    domains = docs.groupBy("domain").count().where("count >= 3").select("domain")
    pages = table(spark, sf_dir, "discovered_links").where("selected_for_crawl").select(F.col("source_page_id").alias("crawled_page_id")).distinct()
    docs = docs.join(jobs, "crawl_job_id", "left_semi").join(domains, "domain", "left_semi").join(pages, "crawled_page_id", "left_semi").select(F.col("id").alias("document_id"))
    return table(spark, sf_dir, "knowledge_chunks").select("id", "document_id").join(docs, "document_id", "left_semi").select("id", "document_id")


@query(rf"SELECT token, count(*) AS postings, count(DISTINCT id) AS passages FROM (SELECT id, unnest(regexp_extract_all(lower(text), {_TOK})) AS token FROM knowledge_chunks) GROUP BY token")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index by token: how often, and in how many passages."""
    tokens = table(spark, sf_dir, "knowledge_chunks").select("id", F.explode(T.tokens(F.col("text"))).alias("token"))
    per = tokens.groupBy("id", "token").agg(F.count("*").alias("tf"))
    return per.groupBy("token").agg(F.sum("tf").alias("postings"), F.count("*").alias("passages"))
