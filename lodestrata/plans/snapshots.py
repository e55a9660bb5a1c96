"""Queries over two states of the graph, and over its nodes, edges, views and paths.

The earlier state is the graph as it stood when the first half of the year was over: documents collected by then,
failed ones included, labels as they were stored, and the occurrences of all passages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import components as C
from lodestrata.operators import dedup
from lodestrata.operators import graph as G
from lodestrata.plans.graph import _EDGES, _NODES, _graph
from lodestrata.plans.registry import query
from lodestrata.sources.tables import table, tables

_THEN = "TIMESTAMP '2024-07-01 00:00:00'"
_NOW_SQL = f"""
docs_now AS (SELECT * FROM knowledge_documents WHERE index_status <> 'FAILED'), docs_then AS (SELECT * FROM knowledge_documents WHERE created_at < {_THEN}),
n_now AS (SELECT 'document:' || id AS node_id, 'DOCUMENT' AS node_type, substr(trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')), 1, 160) AS label FROM docs_now UNION ALL SELECT DISTINCT 'source:' || source_domain, 'SOURCE', source_domain FROM docs_now WHERE source_domain IS NOT NULL),
n_then AS (SELECT 'document:' || id AS node_id, 'DOCUMENT' AS node_type, substr(coalesce(title, ''), 1, 160) AS label FROM docs_then UNION ALL SELECT DISTINCT 'source:' || source_domain, 'SOURCE', source_domain FROM docs_then WHERE source_domain IS NOT NULL),
r_now AS (SELECT 'PART_OF_DOCUMENT' AS edge_type, 'chunk:' || chunk_id AS src, 'document:' || document_id AS dst, CAST(s.id AS VARCHAR) AS entity FROM knowledge_chunk_sources s JOIN docs_now d ON d.id = s.document_id
  UNION ALL SELECT 'MEMBER_OF_SOURCE', 'document:' || id, 'source:' || source_domain, CAST(id AS VARCHAR) FROM docs_now WHERE source_domain IS NOT NULL),
r_then AS (SELECT 'PART_OF_DOCUMENT' AS edge_type, 'chunk:' || chunk_id AS src, 'document:' || document_id AS dst, CAST(id AS VARCHAR) AS entity FROM knowledge_chunk_sources
  UNION ALL SELECT 'MEMBER_OF_SOURCE', 'document:' || id, 'source:' || source_domain, CAST(id AS VARCHAR) FROM docs_then WHERE source_domain IS NOT NULL),
e_now AS (SELECT 'edge:' || sha256(concat_ws(chr(0), edge_type, src, dst, entity)) AS edge_id, edge_type, src, dst FROM r_now), e_then AS (SELECT 'edge:' || sha256(concat_ws(chr(0), edge_type, src, dst, entity)) AS edge_id, edge_type, src, dst FROM r_then)"""


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes and edges now, nodes and edges then; jobs and passages, which do not change, are left aside."""
    docs, sources = tables(spark, sf_dir, "knowledge_documents", "knowledge_chunk_sources")
    now, then = docs.where("index_status <> 'FAILED'"), docs.where(f"created_at < {_THEN}")
    held = sources.join(now.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    none = lambda df: df.limit(0)
    jobs, chunks = tables(spark, sf_dir, "research_jobs", "knowledge_chunks")
    nodes = G.nodes(none(jobs), now, none(chunks))
    stored = G.nodes(none(jobs), then, none(chunks)).where("node_type <> 'DOCUMENT'").unionByName(then.select(G.node_id("DOCUMENT", F.col("id")).alias("node_id"), F.lit("DOCUMENT").alias("node_type"), F.substring(F.coalesce("title", F.lit("")), 1, 160).alias("label")))
    part = lambda e: e.where("edge_type <> 'HAS_DOCUMENT'")
    return nodes, part(G.edges(now, held)), stored, part(G.edges(then, sources))


@query(f"""
WITH {_NOW_SQL},
issues AS (SELECT CASE WHEN b.node_id IS NULL THEN 'MISSING_NODE' WHEN a.node_id IS NULL THEN 'UNEXPECTED_NODE' ELSE 'NODE_PROPERTY_MISMATCH' END AS code, coalesce(a.node_id, b.node_id) AS id FROM n_now a FULL JOIN n_then b USING (node_id) WHERE a.node_id IS NULL OR b.node_id IS NULL OR a.node_type <> b.node_type OR a.label <> b.label
UNION ALL SELECT CASE WHEN b.edge_id IS NULL THEN 'MISSING_EDGE' ELSE 'UNEXPECTED_EDGE' END, coalesce(a.edge_id, b.edge_id) FROM e_now a FULL JOIN e_then b USING (edge_id) WHERE a.edge_id IS NULL OR b.edge_id IS NULL
UNION ALL SELECT 'MISSING_EDGE_TARGET', edge_id FROM e_then WHERE dst NOT IN (SELECT node_id FROM n_then)
UNION ALL SELECT 'MISSING_EDGE_SOURCE', edge_id FROM e_then WHERE src NOT IN (SELECT node_id FROM n_then) AND edge_type = 'MEMBER_OF_SOURCE'
UNION ALL SELECT 'CROSS_JOB_CHUNK', CAST(c.id AS VARCHAR) FROM knowledge_chunks c JOIN knowledge_documents d ON d.id = c.document_id WHERE c.research_job_id IS DISTINCT FROM d.research_job_id
UNION ALL SELECT 'CROSS_JOB_DOCUMENT', CAST(s.id AS VARCHAR) FROM knowledge_chunk_sources s JOIN knowledge_documents d ON d.id = s.document_id WHERE s.research_job_id IS DISTINCT FROM d.research_job_id
UNION ALL SELECT 'CROSS_JOB_CHUNK_SOURCE', CAST(s.id AS VARCHAR) FROM knowledge_chunk_sources s JOIN knowledge_chunks c ON c.id = s.chunk_id WHERE s.research_job_id IS DISTINCT FROM c.research_job_id
UNION ALL SELECT 'ORIGIN_DOCUMENT_MISMATCH', CAST(s.id AS VARCHAR) FROM knowledge_chunk_sources s JOIN knowledge_chunks c ON c.id = s.chunk_id WHERE s.document_id IS DISTINCT FROM c.document_id)
SELECT code, id FROM issues""")
def snapshot_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an audit of the earlier state against the tables finds, one row for each issue."""
    nodes, edges, stored_nodes, stored_edges = _states(spark, sf_dir)
    chunks, sources, docs = tables(spark, sf_dir, "knowledge_chunks", "knowledge_chunk_sources", "knowledge_documents")
    ends = G.issues(stored_nodes, stored_edges.where("edge_type = 'MEMBER_OF_SOURCE'")).unionByName(G.issues(stored_nodes, stored_edges.where("edge_type = 'PART_OF_DOCUMENT'")).where("code = 'MISSING_EDGE_TARGET'"))
    both = G.differences(nodes, stored_nodes, "node_id", ["node_type", "label"], "NODE").unionByName(G.differences(edges, stored_edges, "edge_id", ["edge_type", "src", "dst"], "EDGE"))
    return both.unionByName(ends).unionByName(G.foreign_rows(chunks, sources, docs))


@query(f"""
WITH {_NOW_SQL}
SELECT 'node' AS element, coalesce(a.node_type, b.node_type) AS kind, count(*) FILTER (WHERE b.node_id IS NULL) AS created, count(*) FILTER (WHERE a.node_id IS NOT NULL AND b.node_id IS NOT NULL) AS reused, count(*) FILTER (WHERE a.node_id IS NULL) AS removed FROM n_now a FULL JOIN n_then b USING (node_id) GROUP BY 2
UNION ALL SELECT 'edge', coalesce(a.edge_type, b.edge_type), count(*) FILTER (WHERE b.edge_id IS NULL), count(*) FILTER (WHERE a.edge_id IS NOT NULL AND b.edge_id IS NOT NULL), count(*) FILTER (WHERE a.edge_id IS NULL) FROM e_now a FULL JOIN e_then b USING (edge_id) GROUP BY 2""")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What replacing the earlier state creates, takes over and removes."""
    nodes, edges, stored_nodes, stored_edges = _states(spark, sf_dir)
    row = lambda df, what, kind: df.select(F.lit(what).alias("element"), F.col(kind).alias("kind"), "created", "reused", "removed")
    return row(G.changes(stored_nodes, nodes, "node_id", "node_type"), "node", "node_type").unionByName(row(G.changes(stored_edges, edges, "edge_id", "edge_type"), "edge", "edge_type"))


@query(f"""
WITH {_NODES}, {_EDGES}, x AS (
SELECT 'documents of a job' AS name, count(*) FILTER (WHERE node_id IN (SELECT dst FROM edges WHERE edge_type = 'HAS_DOCUMENT')) AS have, count(*) AS total FROM nodes WHERE node_type = 'DOCUMENT'
UNION ALL SELECT 'documents of a source', count(*) FILTER (WHERE node_id IN (SELECT src FROM edges WHERE edge_type = 'MEMBER_OF_SOURCE')), count(*) FROM nodes WHERE node_type = 'DOCUMENT'
UNION ALL SELECT 'documents with passages', count(*) FILTER (WHERE node_id IN (SELECT dst FROM edges WHERE edge_type = 'PART_OF_DOCUMENT')), count(*) FROM nodes WHERE node_type = 'DOCUMENT'
UNION ALL SELECT 'passages of a document', count(*) FILTER (WHERE node_id IN (SELECT src FROM edges WHERE edge_type = 'PART_OF_DOCUMENT')), count(*) FROM nodes WHERE node_type = 'CHUNK'
UNION ALL SELECT 'jobs with documents', count(*) FILTER (WHERE node_id IN (SELECT src FROM edges WHERE edge_type = 'HAS_DOCUMENT')), count(*) FROM nodes WHERE node_type = 'RESEARCH'
UNION ALL SELECT 'claims with evidence', 0, 0)
SELECT name, have, total, CASE WHEN total = 0 THEN 1.0 ELSE round(have / total, 6) END AS ratio FROM x""")
def graph_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each kind of node is tied in; a kind without nodes is covered."""
    n, e = _graph(spark, sf_dir)
    documents = {"DOCUMENT:in": ("HAS_DOCUMENT", "documents of a job"), "DOCUMENT:out": ("MEMBER_OF_SOURCE", "documents of a source"), "CHUNK:out": ("PART_OF_DOCUMENT", "passages of a document"), "RESEARCH:out": ("HAS_DOCUMENT", "jobs with documents"), "CLAIM:out": ("SUPPORTED_BY", "claims with evidence")}
    return G.coverage(n, e, documents).unionByName(G.coverage(n, e, {"DOCUMENT:in": ("PART_OF_DOCUMENT", "documents with passages")}))


@query(f"""
WITH {_NODES}, l AS (SELECT n.node_id, n.label FROM nodes n JOIN knowledge_documents d ON n.node_id = 'document:' || d.id WHERE d.index_status = 'COMPLETED' AND lower(d.source_domain) LIKE '%.example')
SELECT node_id, label, (SELECT count(*) FROM l) AS total FROM l ORDER BY node_id LIMIT 100 OFFSET 100""")
def node_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the document nodes of one status and a kind of domain."""
    n, _ = _graph(spark, sf_dir)
    docs = table(spark, sf_dir, "knowledge_documents").where("index_status = 'COMPLETED' AND lower(source_domain) LIKE '%.example'").select(G.node_id("DOCUMENT", F.col("id")).alias("node_id"))
    return dedup.page_with_total(n.join(docs, "node_id", "left_semi").select("node_id", "label"), ["node_id"], 100, 100)


_HUB = "'source:' || (SELECT source_domain FROM knowledge_documents WHERE source_domain IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(f"""WITH {_EDGES}, l AS (SELECT edge_id, edge_type, src, dst FROM edges WHERE src = {_HUB} OR dst = {_HUB}) SELECT edge_id, edge_type, src, dst, (SELECT count(*) FROM l) AS total FROM l ORDER BY edge_id LIMIT 50""")
def edge_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of the edges at either end of the largest source."""
    _, e = _graph(spark, sf_dir)
    hub = _largest_source(spark, sf_dir)
    return dedup.page_with_total(e.join(F.broadcast(hub), (F.col("src") == F.col("node")) | (F.col("dst") == F.col("node"))).select("edge_id", "edge_type", "src", "dst"), ["edge_id"], 50)


def _largest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row (node)."""
    d = table(spark, sf_dir, "knowledge_documents").where("source_domain IS NOT NULL").groupBy("source_domain").count()
    return d.orderBy(F.col("count").desc(), "source_domain").limit(1).select(G.node_id("SOURCE", F.col("source_domain")).alias("node"))


@query(f"""
WITH {_NODES}, {_EDGES}, m AS (SELECT src AS node_id, dst AS other, 'out' AS direction FROM edges UNION ALL SELECT dst, src, 'in' FROM edges)
SELECT n.node_id, n.node_type, count(m.other) FILTER (WHERE direction = 'out') AS outgoing, count(m.other) FILTER (WHERE direction = 'in') AS incoming, count(DISTINCT m.other) AS neighbours FROM nodes n LEFT JOIN m USING (node_id) GROUP BY ALL""")
def node_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and distinct neighbours of each node; both are counted before nodes are joined, so hubs are no hot keys."""
    n, e = _graph(spark, sf_dir)
    m = e.select(F.col("src").alias("node_id"), F.col("dst").alias("other"), F.lit(1).alias("o")).unionByName(e.select(F.col("dst").alias("node_id"), F.col("src").alias("other"), F.lit(0).alias("o")))
    pairs = m.groupBy("node_id", "other").agg(F.sum("o").alias("out"), F.count("*").alias("all"))
    per = pairs.groupBy("node_id").agg(F.sum("out").alias("outgoing"), (F.sum("all") - F.sum("out")).alias("incoming"), F.count("*").alias("neighbours"))
    return n.select("node_id", "node_type").join(per, "node_id", "left").fillna(0, ["outgoing", "incoming", "neighbours"])


@query(f"""
WITH {_NODES}, {_EDGES}, o AS (SELECT n.node_id, t.edge_type, (SELECT count(*) FROM edges e WHERE e.edge_type = t.edge_type AND e.dst = n.node_id) AS degree FROM nodes n, (VALUES ('HAS_DOCUMENT'), ('PART_OF_DOCUMENT')) t(edge_type) WHERE n.node_type = 'DOCUMENT')
SELECT edge_type, degree, count(*) AS documents FROM o GROUP BY ALL""")
def degrees_by_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have how many jobs and passages, none included."""
    n, e = _graph(spark, sf_dir)
    documents = n.where("node_type = 'DOCUMENT'").select("node_id", F.explode(F.array(F.lit("HAS_DOCUMENT"), F.lit("PART_OF_DOCUMENT"))).alias("edge_type"))
    into = e.groupBy(F.col("dst").alias("node_id"), "edge_type").agg(F.count("*").alias("degree"))
    return documents.join(into, ["node_id", "edge_type"], "left").fillna(0, ["degree"]).groupBy("edge_type", "degree").agg(F.count("*").alias("documents"))


@query(f"""
WITH {_NODES}, {_EDGES}, e AS (SELECT edges.* FROM edges WHERE edge_type IN ('PART_OF_DOCUMENT', 'MEMBER_OF_SOURCE')), s AS (SELECT node_id AS seed FROM nodes WHERE node_type = 'SOURCE'),
d1 AS (SELECT DISTINCT s.seed, e.src AS node FROM s JOIN e ON e.dst = s.seed), d2 AS (SELECT DISTINCT d1.seed, e.src AS node FROM d1 JOIN e ON e.dst = d1.node),
r AS (SELECT seed, seed AS node, 0 AS distance FROM s UNION ALL SELECT seed, node, 1 FROM d1 UNION ALL SELECT seed, node, 2 FROM d2 WHERE (seed, node) NOT IN (SELECT (seed, node) FROM d1)),
k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY seed ORDER BY distance, node) <= 40),
m AS (SELECT DISTINCT a.seed, e.edge_id FROM k a JOIN e ON e.dst = a.node JOIN k b ON b.seed = a.seed AND b.node = e.src WHERE a.distance < 2)
SELECT seed, count(*) AS nodes, (SELECT count(*) FROM m WHERE m.seed = k.seed) AS edges, (SELECT count(*) FROM r WHERE r.seed = k.seed) > 40 AS truncated FROM k GROUP BY seed""")
def neighbourhood_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty nodes around each source, within two edges of two types."""
    n, e = _graph(spark, sf_dir)
    seeds = n.where("node_type = 'SOURCE'").select(F.col("node_id").alias("node"))
    return C.view(n, e, seeds, 2, direction="in", node_types=["DOCUMENT", "CHUNK", "SOURCE"], edge_types=["PART_OF_DOCUMENT", "MEMBER_OF_SOURCE"], most_nodes=40)


@query(f"""
WITH {_EDGES}, pairs AS (SELECT DISTINCT 'research:' || research_job_id AS source, 'source:' || source_domain AS target FROM knowledge_documents WHERE research_job_id IS NOT NULL AND source_domain IS NOT NULL)
SELECT p.source, p.target, a.edge_id || ' ' || b.edge_id AS path FROM pairs p JOIN edges a ON a.src = p.source JOIN edges b ON b.src = a.dst AND b.dst = p.target QUALIFY row_number() OVER (PARTITION BY p.source, p.target ORDER BY a.edge_id, b.edge_id) <= 3""")
def path_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three of the shortest paths from each research job to each source it drew on."""
    _, e = _graph(spark, sf_dir)
    docs = table(spark, sf_dir, "knowledge_documents").where("research_job_id IS NOT NULL AND source_domain IS NOT NULL")
    pairs = docs.select(G.node_id("RESEARCH", F.col("research_job_id")).alias("source"), G.node_id("SOURCE", F.col("source_domain")).alias("target")).distinct()
    return C.list_paths(e, pairs, 3, 3).select("source", "target", F.array_join("path", " ").alias("path"))
