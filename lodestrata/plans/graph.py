"""Queries over the graph of jobs, documents, passages and sources, and over the links between pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import components as C
from lodestrata.operators import graph as G
from lodestrata.plans.registry import query
from lodestrata.sources.tables import table, tables

_NODES = """
nodes AS (SELECT 'research:' || id AS node_id, 'RESEARCH' AS node_type, substr(trim(regexp_replace(coalesce(question, ''), '\\s+', ' ', 'g')), 1, 160) AS label FROM research_jobs
UNION ALL SELECT 'document:' || id, 'DOCUMENT', substr(trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')), 1, 160) FROM knowledge_documents
UNION ALL SELECT 'chunk:' || id, 'CHUNK', coalesce(text_hash, '') FROM knowledge_chunks
UNION ALL SELECT DISTINCT 'source:' || source_domain, 'SOURCE', source_domain FROM knowledge_documents WHERE source_domain IS NOT NULL)"""
_EDGES = """
raw AS (SELECT 'HAS_DOCUMENT' AS edge_type, 'research:' || research_job_id AS src, 'document:' || id AS dst, CAST(id AS VARCHAR) AS entity FROM knowledge_documents WHERE research_job_id IS NOT NULL
UNION ALL SELECT 'PART_OF_DOCUMENT', 'chunk:' || chunk_id, 'document:' || document_id, CAST(id AS VARCHAR) FROM knowledge_chunk_sources
UNION ALL SELECT 'MEMBER_OF_SOURCE', 'document:' || id, 'source:' || source_domain, CAST(id AS VARCHAR) FROM knowledge_documents WHERE source_domain IS NOT NULL),
edges AS (SELECT 'edge:' || sha256(concat_ws(chr(0), edge_type, src, dst, entity)) AS edge_id, edge_type, src, dst FROM raw)"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    jobs, docs, chunks, sources = tables(spark, sf_dir, "research_jobs", "knowledge_documents", "knowledge_chunks", "knowledge_chunk_sources")
    return G.nodes(jobs, docs, chunks), G.edges(docs, sources)


def _page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the URL of a page to the URL that it links to."""
    links = table(spark, sf_dir, "discovered_links").where("normalized_target_url IS NOT NULL").select(F.col("source_page_id").alias("id"), F.col("normalized_target_url").alias("dst")).distinct()
    pages = table(spark, sf_dir, "crawled_pages").where("normalized_url IS NOT NULL").select("id", F.col("normalized_url").alias("src"))
    return links.join(pages, "id").select("src", "dst")


_PAGE_LINKS = """
links AS (SELECT p.normalized_url AS src, l.normalized_target_url AS dst FROM (SELECT DISTINCT source_page_id, normalized_target_url FROM discovered_links WHERE normalized_target_url IS NOT NULL) l JOIN crawled_pages p ON p.id = l.source_page_id WHERE p.normalized_url IS NOT NULL)"""


@query(f"WITH {_NODES} SELECT * FROM nodes")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[0]


@query(f"WITH {_EDGES} SELECT * FROM edges")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[1]


@query(f"""WITH {_NODES}, {_EDGES}
SELECT 'MISSING_EDGE_SOURCE' AS code, edge_id AS id FROM edges WHERE src NOT IN (SELECT node_id FROM nodes) UNION ALL SELECT 'MISSING_EDGE_TARGET', edge_id FROM edges WHERE dst NOT IN (SELECT node_id FROM nodes)
UNION ALL SELECT 'REPEATED_NODE', node_id FROM nodes GROUP BY node_id HAVING count(*) > 1""")
def graph_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.issues(*_graph(spark, sf_dir))


@query(f"""WITH {_NODES}, {_EDGES}, o AS (SELECT src AS node_id, count(*) AS outgoing FROM edges GROUP BY 1), i AS (SELECT dst AS node_id, count(*) AS incoming FROM edges GROUP BY 1),
d AS (SELECT node_type, coalesce(outgoing, 0) AS outgoing, coalesce(incoming, 0) AS incoming FROM nodes LEFT JOIN o USING (node_id) LEFT JOIN i USING (node_id))
SELECT node_type, outgoing, incoming, count(*) AS nodes FROM d GROUP BY ALL""")
def degree_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(*_graph(spark, sf_dir)).groupBy("node_type", "outgoing", "incoming").agg(F.count("*").alias("nodes"))


@query(f"""WITH {_NODES}, {_EDGES} SELECT 'node' AS element, node_type AS kind, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY ALL""")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _graph(spark, sf_dir)
    return n.groupBy(F.lit("node").alias("element"), F.col("node_type").alias("kind")).agg(F.count("*").alias("n")).unionByName(e.groupBy(F.lit("edge").alias("element"), F.col("edge_type").alias("kind")).agg(F.count("*").alias("n")))


_DIGEST = "SELECT '{0}' AS element, count(*) AS rows, sha256(concat_ws(':', count(*)::VARCHAR, {1})) AS digest FROM (SELECT sha256({2}) AS h FROM {0})"
_SUMS = ", ".join(f"sum(CAST('0x' || substr(h, {a}, 12) AS BIGINT))::VARCHAR" for a in (1, 13, 25, 37))


@query(f"""WITH {_NODES}, {_EDGES} {_DIGEST.format('nodes', _SUMS, "concat_ws(chr(0), node_id, node_type, label)")} UNION ALL {_DIGEST.format('edges', _SUMS, "concat_ws(chr(0), edge_id, edge_type, src, dst)")}""")
def graph_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _graph(spark, sf_dir)
    a = G.content_digest(n, ["node_id", "node_type", "label"]).select(F.lit("nodes").alias("element"), "rows", "digest")
    return a.unionByName(G.content_digest(e, ["edge_id", "edge_type", "src", "dst"]).select(F.lit("edges").alias("element"), "rows", "digest"))


@query(f"""WITH RECURSIVE {_PAGE_LINKS}, both_ AS (SELECT src AS a, dst AS b FROM links WHERE src <> dst UNION SELECT dst, src FROM links WHERE src <> dst),
walk AS (SELECT DISTINCT x AS node, x AS seen FROM (SELECT src AS x FROM links UNION SELECT dst FROM links) UNION SELECT walk.node, both_.b FROM walk JOIN both_ ON walk.seen = both_.a)
SELECT node, min(seen) AS component FROM walk GROUP BY node""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the pages, by the links between them."""
    return C.connected_components(_page_links(spark, sf_dir))


@query(f"""WITH RECURSIVE {_NODES}, {_EDGES}, walk AS (SELECT node_id AS seed, node_id AS node, 0 AS d FROM nodes WHERE node_type = 'SOURCE' UNION SELECT walk.seed, edges.src, d + 1 FROM walk JOIN edges ON walk.node = edges.dst WHERE d < 2)
SELECT seed, node, min(d) AS distance FROM walk GROUP BY ALL""")
def bfs_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands within two edges of each source: its documents, their passages and jobs."""
    n, e = _graph(spark, sf_dir)
    return C.neighbourhood(e, n.where("node_type = 'SOURCE'").select(F.col("node_id").alias("node")), 2, direction="in")


@query(f"""WITH {_EDGES}, pairs AS (SELECT DISTINCT 'research:' || research_job_id AS source, 'source:' || source_domain AS target FROM knowledge_documents WHERE research_job_id IS NOT NULL AND source_domain IS NOT NULL)
SELECT p.source, p.target, 2 AS hops, count(*) AS paths FROM pairs p JOIN edges a ON a.src = p.source JOIN edges b ON b.src = a.dst AND b.dst = p.target GROUP BY ALL""")
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each research job to each source it drew on, parallel ways counted."""
    _, e = _graph(spark, sf_dir)
    docs = table(spark, sf_dir, "knowledge_documents").where("research_job_id IS NOT NULL AND source_domain IS NOT NULL")
    pairs = docs.select(G.node_id("RESEARCH", F.col("research_job_id")).alias("source"), G.node_id("SOURCE", F.col("source_domain")).alias("target")).distinct()
    return C.shortest_paths(e, pairs, 3)


@query(f"""WITH {_EDGES} SELECT node, direction, edge_type, count(*) AS n FROM (SELECT src AS node, 'out' AS direction, edge_type FROM edges UNION ALL SELECT dst, 'in', edge_type FROM edges) GROUP BY ALL""")
def node_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, e = _graph(spark, sf_dir)
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit("out").alias("direction")), F.struct(F.col("dst").alias("node"), F.lit("in").alias("direction"))))
    return e.select(ends.alias("x"), "edge_type").select("x.node", "x.direction", "edge_type").groupBy("node", "direction", "edge_type").agg(F.count("*").alias("n"))
