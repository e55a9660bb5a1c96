"""Queries that measure rankings, labels, runs and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import scoring
from lodestrata.functions import text as T
from lodestrata.operators import dedup, evaluate
from lodestrata.operators.ranking import capped, fuse
from lodestrata.plans.registry import query
from lodestrata.plans.retrieval import dense_topk
from lodestrata.sources.tables import table, tables


@query("""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 6) AS similarity FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s QUALIFY rank <= 10),
g AS (SELECT q.vec_id AS query_id, v.vec_id AS id FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND q.label = v.label),
h AS (SELECT query_id, count(*) FILTER (WHERE rank <= 5) AS found, min(rank) AS first, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS gain FROM r JOIN g USING (query_id, id) GROUP BY 1),
i AS (SELECT query_id, count(*) AS wanted FROM g GROUP BY 1), b AS (SELECT query_id, wanted, (SELECT sum(1 / log2(x + 1)) FROM range(1, 6) t(x) WHERE x <= wanted) AS best FROM i)
SELECT query_id, round(coalesce(found, 0) / wanted, 6) AS recall, round(coalesce(found, 0) / 5, 6) AS precision, round(coalesce(1 / first, 0), 6) AS mrr, round(coalesce(gain / best, 0), 6) AS ndcg, coalesce(found, 0) > 0 AS hit FROM b LEFT JOIN h USING (query_id)""")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the dense ranking: vectors of the query's label are relevant."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    q = v.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "label")
    relevant = q.join(v, "label").where("query_id <> vec_id").select("query_id", F.col("vec_id").alias("id"), F.lit(1).alias("grade"))
    return evaluate.ranking_metrics(dense_topk(spark, sf_dir).select("query_id", "id", "rank"), relevant, 5)


_DENSE_RANKING = """
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 6) AS similarity FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s QUALIFY rank <= 10)"""


@query(f"""
WITH {_DENSE_RANKING}, g AS (SELECT q.vec_id AS query_id, v.vec_id AS id FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND q.label = v.label), src AS (SELECT vec_id AS id, vec_id // 25 AS source FROM v),
gs AS (SELECT g.query_id, g.id, src.source FROM g JOIN src USING (id)), f AS (SELECT r.query_id, r.id, r.rank, src.source, EXISTS (SELECT 1 FROM g WHERE g.query_id = r.query_id AND g.id = r.id) AS hit, EXISTS (SELECT 1 FROM gs WHERE gs.query_id = r.query_id AND gs.source = src.source) AS good FROM r JOIN src USING (id) WHERE rank <= 8),
a AS (SELECT query_id, count(*) AS items, count(DISTINCT source) AS all_sources FROM gs GROUP BY 1)
SELECT query_id, round(coalesce(count(*) FILTER (WHERE hit) / any_value(items), 0), 6) AS recall, round(coalesce(1 / min(rank) FILTER (WHERE hit), 0), 6) AS mrr, count(DISTINCT source) FILTER (WHERE good) AS relevant_sources,
  round(coalesce(count(DISTINCT source) FILTER (WHERE good) / any_value(all_sources), 0), 6) AS source_recall, count(*) AS retrieved, count(DISTINCT source) AS retrieved_sources FROM f LEFT JOIN a USING (query_id) GROUP BY query_id""")
def retrieval_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the dense ranking: vectors of the query's label are relevant, 25 vectors in a row are one source."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    sources = v.select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 25).alias("source"))
    return evaluate.retrieval_run(dense_topk(spark, sf_dir).select("query_id", "id", "rank"), _same_label(v), sources, 8)


def _same_label(v: DataFrame) -> DataFrame:
    q = v.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "label")
    return q.join(v, "label").where("query_id <> vec_id").select("query_id", F.col("vec_id").alias("id"))


@query(f"""
WITH {_DENSE_RANKING}, g AS (SELECT q.vec_id AS query_id, v.vec_id AS id FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND q.label = v.label),
h AS (SELECT query_id, count(*) FILTER (WHERE rank <= 5) AS found, min(rank) AS first FROM r JOIN g USING (query_id, id) GROUP BY 1), w AS (SELECT query_id, count(*) AS wanted FROM g GROUP BY 1),
m AS (SELECT query_id, round(coalesce(found, 0) / wanted, 6) AS recall, round(coalesce(found, 0) / 5, 6) AS precision, round(coalesce(1 / first, 0), 6) AS mrr FROM w LEFT JOIN h USING (query_id))
SELECT count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(mrr), 6) AS mrr FROM m""")
def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The means of ``ranking_metrics`` over all queries."""
    return evaluate.macro(ranking_metrics(spark, sf_dir), ["recall", "precision", "mrr"])


_SHIP = "SELECT CASE WHEN o_orderpriority <= '2' THEN 'fast' WHEN o_orderpriority <= '4' THEN 'normal' ELSE 'slow' END AS gold, CASE WHEN l_quantity > 34 THEN 'fast' WHEN l_quantity > 17 THEN 'normal' ELSE 'slow' END AS predicted FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labels of each line item, one from its order's priority and one from its quantity."""
    li, o = tables(spark, sf_dir, "lineitem", "orders")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    p, q = F.col("o_orderpriority"), F.col("l_quantity")
    return j.select(F.when(p <= "2", "fast").when(p <= "4", "normal").otherwise("slow").alias("gold"), F.when(q > 34, "fast").when(q > 17, "normal").otherwise("slow").alias("predicted"))


@query(f"SELECT gold, predicted, count(*) AS n FROM ({_SHIP}) GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_labels(spark, sf_dir), "gold", "predicted")


@query(f"""WITH m AS (SELECT gold, predicted, count(*) AS n FROM ({_SHIP}) GROUP BY ALL), g AS (SELECT gold AS label, sum(n) AS support, sum(n) FILTER (WHERE gold = predicted) AS ok FROM m GROUP BY 1), t AS (SELECT predicted AS label, sum(n) AS told FROM m GROUP BY 1),
d AS (SELECT label, coalesce(ok, 0) / told AS p, coalesce(ok, 0) / support AS r, support FROM g JOIN t USING (label))
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, CAST(support AS BIGINT) AS support FROM d""")
def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.label_metrics(evaluate.confusion(_labels(spark, sf_dir), "gold", "predicted"))


@query(f"""WITH m AS (SELECT gold, predicted, count(*) AS n FROM ({_SHIP}) GROUP BY ALL), g AS (SELECT gold AS label, sum(n) AS support, sum(n) FILTER (WHERE gold = predicted) AS ok FROM m GROUP BY 1), t AS (SELECT predicted AS label, sum(n) AS told FROM m GROUP BY 1),
d AS (SELECT label, coalesce(ok, 0) / told AS p, coalesce(ok, 0) / support AS r FROM g JOIN t USING (label))
SELECT count(*) AS labels, round(avg(round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6)), 6) AS macro_f1, (SELECT round(sum(n) FILTER (WHERE gold = predicted) / sum(n), 6) FROM m) AS accuracy FROM d""")
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.label_summary(evaluate.confusion(_labels(spark, sf_dir), "gold", "predicted"))


@query(r"""
WITH w AS (SELECT id, list_distinct(list_filter(list_transform(string_split(lower(trim(regexp_replace(question, '\s+', ' ', 'g'))), ' '), lambda x: trim(x, '.,:;!?()[]{}')), lambda x: x <> '')) AS s FROM research_jobs WHERE question IS NOT NULL),
p AS (SELECT count(*) FILTER (WHERE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) >= 0.8) AS alike FROM w a JOIN w b ON a.id < b.id), n AS (SELECT count(*) AS n FROM w)
SELECT n AS questions, alike, round(CASE WHEN n > 1 THEN alike / (n * (n - 1) / 2) ELSE 0 END, 6) AS redundancy, round(CASE WHEN n > 1 THEN 1 - alike / (n * (n - 1) / 2) ELSE 1 END, 6) AS diversity FROM p, n""")
def plan_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of all pairs of questions share four fifths of their words."""
    sets = table(spark, sf_dir, "research_jobs").where("question IS NOT NULL").select("id", T.word_set(F.col("question")).alias("s"))
    alike = evaluate.similar_sets(sets, 0.8).agg(F.count("*").alias("alike"))
    n = F.col("questions")
    share = F.when(n > 1, F.col("alike") / (n * (n - 1) / 2)).otherwise(0.0)
    return sets.agg(F.count("*").alias("questions")).crossJoin(alike).select("questions", "alike", F.round(share, 6).alias("redundancy"), F.round(1 - share, 6).alias("diversity"))  # one row each


@query("SELECT crawl_job_id, count(actual_page_relevance) AS n, round(avg(actual_page_relevance), 6) AS mean, round(median(actual_page_relevance), 6) AS median, min(actual_page_relevance) AS least, max(actual_page_relevance) AS most FROM crawled_pages GROUP BY crawl_job_id")
def relevance_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.distribution(table(spark, sf_dir, "crawled_pages"), ["crawl_job_id"], "actual_page_relevance")


@query(r"""
WITH w AS (SELECT id, list_distinct(list_filter(list_transform(string_split(lower(trim(regexp_replace(question, '\s+', ' ', 'g'))), ' '), lambda x: trim(x, '.,:;!?()[]{}')), lambda x: x <> '')) AS s FROM research_jobs WHERE question IS NOT NULL),
c AS (SELECT research_job_id AS id, count(*) AS n FROM knowledge_documents GROUP BY 1)
SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS overlap, coalesce(x.n, 0) + coalesce(y.n, 0) AS documents FROM w a JOIN w b ON a.id < b.id LEFT JOIN c x ON x.id = a.id LEFT JOIN c y ON y.id = b.id
WHERE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) >= 0.5""")
def redundant_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of questions that share half of their words, joined through their rarer words, with the documents they drew in."""
    jobs, docs = tables(spark, sf_dir, "research_jobs", "knowledge_documents")
    sets = jobs.where("question IS NOT NULL").select("id", T.word_set(F.col("question")).alias("s"))
    n = docs.groupBy(F.col("research_job_id")).agg(F.count("*").alias("n"))
    pairs = evaluate.similar_sets(sets, 0.5).select("a", "b", F.round("overlap", 6).alias("overlap"))
    with_a = pairs.join(n.toDF("a", "x"), "a", "left").join(n.toDF("b", "y"), "b", "left")
    return with_a.select("a", "b", "overlap", (F.coalesce("x", F.lit(0)) + F.coalesce("y", F.lit(0))).alias("documents"))


@query("""
WITH e AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE ts IS NOT NULL), f AS (SELECT user_id, k, min(day) AS first FROM e WHERE k IS NOT NULL GROUP BY ALL)
SELECT user_id, day, count(*) AS items, count(*) FILTER (WHERE first = day) AS fresh FROM (SELECT DISTINCT user_id, day, k FROM e WHERE k IS NOT NULL) JOIN f USING (user_id, k) GROUP BY ALL""")
def novelty_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("ts IS NOT NULL").select("user_id", F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").cast("int").alias("k")).where("k IS NOT NULL")
    return evaluate.novelty(e, "user_id", "k", "day")


@query("""
WITH d AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) FILTER (WHERE event_type = 'purchase') > 0 AS reset FROM events WHERE ts IS NOT NULL GROUP BY ALL),
r AS (SELECT *, sum(CAST(reset AS INT)) OVER (PARTITION BY user_id ORDER BY day) AS run FROM d)
SELECT user_id, day, reset, sum(CAST(NOT reset AS INT)) OVER (PARTITION BY user_id, run ORDER BY day) AS streak FROM r""")
def stagnation_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").where("ts IS NOT NULL").groupBy("user_id", F.to_date("ts").alias("day")).agg((F.count_if(F.col("event_type") == "purchase") > 0).alias("reset"))
    return evaluate.streaks(d, "user_id", "day", "reset")


@query("""
WITH d AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS used FROM events WHERE ts IS NOT NULL GROUP BY ALL)
SELECT user_id, day, used, greatest(0, 50 - sum(used) OVER (PARTITION BY user_id ORDER BY day)) AS remaining FROM d""")
def budget_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").where("ts IS NOT NULL").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("used"))
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("user_id", "day", "used", F.greatest(F.lit(0), 50 - F.sum("used").over(w)).alias("remaining"))


@query("""
SELECT user_id, event_type, event_id, ts, value FROM events WHERE ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("ts IS NOT NULL")
    return dedup.latest(e.select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "ts", "value")


_SEEDS = """
WITH s AS (SELECT l.crawl_job_id, l.normalized_target_url AS url, coalesce(max(l.relevance_score), 0) AS similarity, min(l.id) AS first FROM discovered_links l WHERE normalized_target_url IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY crawl_job_id ORDER BY first) AS rank FROM s), c AS (SELECT crawl_job_id, url, round(0.85 * (similarity + 1) / 2 + 0.15 / log2(rank + 1), 9) AS score, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host FROM r),
d AS (SELECT *, row_number() OVER (PARTITION BY crawl_job_id, host ORDER BY score DESC, url) AS rd FROM c QUALIFY rd <= 2)
SELECT crawl_job_id, url, round(score, 6) AS score, row_number() OVER (PARTITION BY crawl_job_id ORDER BY score DESC, url) AS position FROM d QUALIFY position <= 10"""


@query(_SEEDS)
def seed_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every link; a target without any score counts 0."""
    return _seeds(table(spark, sf_dir, "discovered_links"))


@query(_SEEDS)
def seed_selection_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeds(table(spark, sf_dir, "discovered_links"))


def _seeds(links: DataFrame) -> DataFrame:
    """The ten best targets of each crawl, at most two of one host, by similarity, 0 where there is none, and order of discovery."""
    known = links.where("normalized_target_url IS NOT NULL")
    s = known.groupBy("crawl_job_id", F.col("normalized_target_url").alias("url")).agg(F.coalesce(F.max("relevance_score"), F.lit(0.0)).alias("similarity"), F.min("id").alias("first"))
    from lodestrata.operators.ranking import positions

    ranked = positions(s, ["crawl_job_id"], F.floor(F.col("first") / 4096), ["first"], "rank")
    c = ranked.select("crawl_job_id", "url", F.round(scoring.seed_score(F.col("similarity"), F.col("rank")), 9).alias("score"), F.regexp_extract("url", "^[a-z]+://([^/?#:]*)", 1).alias("host"))
    best = capped(c, ["crawl_job_id"], "host", [F.col("score").desc(), "url"], 2, 10)
    return best.select("crawl_job_id", "url", F.round("score", 6).alias("score"), "position")


@query("""
WITH a AS (SELECT p.crawl_job_id, p.id, row_number() OVER (PARTITION BY p.crawl_job_id ORDER BY actual_page_relevance DESC, id) AS by_page FROM crawled_pages p WHERE actual_page_relevance IS NOT NULL),
b AS (SELECT p.crawl_job_id, p.id, row_number() OVER (PARTITION BY p.crawl_job_id ORDER BY predicted_link_relevance DESC, id) AS by_link FROM crawled_pages p WHERE predicted_link_relevance IS NOT NULL)
SELECT crawl_job_id, id, by_page, by_link, round(coalesce(1.0::DOUBLE / (60 + by_page), 0) + coalesce(1.0::DOUBLE / (60 + by_link), 0), 9) AS rrf FROM a FULL JOIN b USING (crawl_job_id, id)""")
def relevance_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted and actual relevance of all pages of a job, fused by reciprocal rank."""
    p = table(spark, sf_dir, "crawled_pages")
    from lodestrata.operators.ranking import positions

    def ranked(score: str, name: str) -> DataFrame:
        scored = p.where(F.col(score).isNotNull()).select(F.struct("crawl_job_id").alias("job"), "crawl_job_id", "id", score)  # a struct: pages without a job stay
        return positions(scored, ["job"], F.floor(F.col(score) * 64), [F.col(score).desc(), "id"], name, descending=True)

    a, b = ranked("actual_page_relevance", "by_page"), ranked("predicted_link_relevance", "by_link")
    return fuse([(a, "by_page", 1.0), (b, "by_link", 1.0)], ["crawl_job_id", "id"]).select("crawl_job_id", "id", "by_page", "by_link", F.round("rrf", 9).alias("rrf"))


@query("""
SELECT d.id, CASE WHEN p.id IS NULL THEN 'missing page' WHEN p.content_hash IS DISTINCT FROM d.content_hash THEN 'different' END AS issue FROM knowledge_documents d LEFT JOIN crawled_pages p ON p.id = d.crawled_page_id
WHERE p.id IS NULL OR p.content_hash IS DISTINCT FROM d.content_hash""")
def document_page_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = tables(spark, sf_dir, "knowledge_documents", "crawled_pages")
    j = docs.select("id", "crawled_page_id", F.col("content_hash").alias("own")).join(pages.select(F.col("id").alias("crawled_page_id"), F.col("content_hash").alias("theirs"), F.lit(True).alias("here")), "crawled_page_id", "left")
    issue = F.when(F.col("here").isNull(), "missing page").when(~F.col("own").eqNullSafe(F.col("theirs")), "different")
    return j.select("id", issue.alias("issue")).where(F.col("issue").isNotNull())


@query("""
WITH o AS (SELECT normalized_url AS url, content_hash AS h FROM crawled_pages WHERE depth = 0 AND content_hash IS NOT NULL), n AS (SELECT normalized_url AS url, content_hash AS h FROM crawled_pages WHERE depth > 0 AND content_hash IS NOT NULL),
a AS (SELECT DISTINCT url, h FROM o), b AS (SELECT DISTINCT url, h FROM n)
SELECT 'only start pages' AS part, count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'only deeper pages', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'both', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by URL and content, of the starts of crawls and of what lies deeper: one aggregate that keeps both memberships."""
    p = table(spark, sf_dir, "crawled_pages").where("content_hash IS NOT NULL AND depth IS NOT NULL")
    m = p.groupBy("normalized_url", "content_hash").agg(F.bool_or(F.col("depth") == 0).alias("a"), F.bool_or(F.col("depth") > 0).alias("b"))
    n = m.agg(F.count_if(F.col("a") & ~F.col("b")).alias("x"), F.count_if(F.col("b") & ~F.col("a")).alias("y"), F.count_if(F.col("a") & F.col("b")).alias("z"), F.count("*").alias("t"))
    return n.selectExpr("stack(4, 'only start pages', x, 'only deeper pages', y, 'both', z, 'either', t) AS (part, n)")


@query("SELECT research_job_id, count(*) AS documents, count(DISTINCT source_domain) AS domains, count(DISTINCT content_hash) AS contents, count(*) FILTER (WHERE index_status ILIKE 'indexed' OR index_status ILIKE 'completed') AS finished FROM knowledge_documents GROUP BY research_job_id")
def source_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.lower("index_status")
    return table(spark, sf_dir, "knowledge_documents").groupBy("research_job_id").agg(F.count("*").alias("documents"), F.count_distinct("source_domain").alias("domains"), F.count_distinct("content_hash").alias("contents"), F.count_if(s.isin("indexed", "completed")).alias("finished"))


@query("""
WITH x AS (SELECT n_regionkey, c_mktsegment, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT r_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM x JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def segment_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star join with small sides, aggregated in part before each shuffle."""
    o, c, n, r = tables(spark, sf_dir, "orders", "customer", "nation", "region")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT id, question, n FROM (SELECT j.id, j.question, count(d.id) AS n FROM research_jobs j LEFT JOIN knowledge_documents d ON d.research_job_id = j.id GROUP BY ALL) ORDER BY n DESC, id LIMIT 10 OFFSET 10")
def listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the listing of research jobs by their documents."""
    jobs, docs = tables(spark, sf_dir, "research_jobs", "knowledge_documents")
    n = docs.groupBy(F.col("research_job_id").alias("id")).agg(F.count("*").alias("n"))
    rows = jobs.select("id", "question").join(n, "id", "left").fillna(0, ["n"])
    return dedup.page_of(rows, [F.col("n").desc(), "id"], 10, 10)
