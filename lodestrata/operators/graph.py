"""A typed directed multigraph of research jobs, documents, passages and sources: built, hashed, audited, summed up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import label
from lodestrata.operators.dedup import difference


def node_id(kind: str, entity: Column) -> Column:
    return F.concat(F.lit(kind.lower() + ":"), entity.cast("string"))


def edge_id(kind: Column, source: Column, target: Column, entity: Column) -> Column:
    """Equal for equal parts; parallel edges differ by their entity."""
    return F.concat(F.lit("edge:"), F.sha2(F.concat_ws("\0", kind, source, target, entity.cast("string")), 256))


def nodes(jobs: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(node_id, node_type, label) of jobs, documents, passages and source domains."""
    parts = [
        jobs.select(node_id("RESEARCH", F.col("id")).alias("node_id"), F.lit("RESEARCH").alias("node_type"), label(F.coalesce("question", F.lit(""))).alias("label")),
        documents.select(node_id("DOCUMENT", F.col("id")).alias("node_id"), F.lit("DOCUMENT").alias("node_type"), label(F.coalesce("title", F.lit(""))).alias("label")),
        chunks.select(node_id("CHUNK", F.col("id")).alias("node_id"), F.lit("CHUNK").alias("node_type"), F.coalesce("text_hash", F.lit("")).alias("label")),
        documents.where("source_domain IS NOT NULL").select(node_id("SOURCE", F.col("source_domain")).alias("node_id"), F.lit("SOURCE").alias("node_type"), F.col("source_domain").alias("label")).distinct(),
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """(edge_id, edge_type, src, dst): documents of jobs, passages of documents (one for each occurrence), members of sources."""
    research, document = node_id("RESEARCH", F.col("research_job_id")), node_id("DOCUMENT", F.col("id"))
    parts = [
        documents.where("research_job_id IS NOT NULL").select(F.lit("HAS_DOCUMENT").alias("edge_type"), research.alias("src"), document.alias("dst"), F.col("id").cast("string").alias("entity")),
        sources.select(F.lit("PART_OF_DOCUMENT").alias("edge_type"), node_id("CHUNK", F.col("chunk_id")).alias("src"), node_id("DOCUMENT", F.col("document_id")).alias("dst"), F.col("id").cast("string").alias("entity")),
        documents.where("source_domain IS NOT NULL").select(F.lit("MEMBER_OF_SOURCE").alias("edge_type"), document.alias("src"), node_id("SOURCE", F.col("source_domain")).alias("dst"), F.col("id").cast("string").alias("entity")),
    ]
    every = reduce(DataFrame.unionByName, parts)
    return every.select(edge_id(F.col("edge_type"), F.col("src"), F.col("dst"), F.col("entity")).alias("edge_id"), "edge_type", "src", "dst")


def content_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, digest): equal for equal rows in any order and partitioning. Sums of row hashes, so nothing is gathered or sorted."""
    h = F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in columns]), 256)
    part = lambda a: F.conv(F.substring(h, a, 12), 16, 10).cast("decimal(38,0)")
    sums = [F.coalesce(F.sum(part(a)), F.lit(0)).alias(f"s{a}") for a in (1, 13, 25, 37)]
    return df.agg(F.count("*").alias("rows"), *sums).select("rows", F.sha2(F.concat_ws(":", "rows", "s1", "s13", "s25", "s37"), 256).alias("digest"))


def issues(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """(code, id): dangling ends and repeated ids."""
    ids = nodes_.select(F.col("node_id").alias("n")).distinct()
    no_source = edges_.join(ids, F.col("src") == F.col("n"), "left_anti").select(F.lit("MISSING_EDGE_SOURCE").alias("code"), F.col("edge_id").alias("id"))
    no_target = edges_.join(ids, F.col("dst") == F.col("n"), "left_anti").select(F.lit("MISSING_EDGE_TARGET").alias("code"), F.col("edge_id").alias("id"))
    twice = nodes_.groupBy("node_id").count().where("count > 1").select(F.lit("REPEATED_NODE").alias("code"), F.col("node_id").alias("id"))
    return no_source.unionByName(no_target).unionByName(twice)


def differences(expected: DataFrame, actual: DataFrame, key: str, values: list[str], name: str) -> DataFrame:
    """(code, id) of two states of nodes or edges: MISSING_, UNEXPECTED_ and, where the values differ, _PROPERTY_MISMATCH."""
    d = difference(expected, actual, [key], values)
    code = F.when(F.col("issue") == "missing", f"MISSING_{name}").when(F.col("issue") == "unexpected", f"UNEXPECTED_{name}").otherwise(f"{name}_PROPERTY_MISMATCH")
    return d.select(code.alias("code"), F.col(key).alias("id"))


def foreign_rows(chunks: DataFrame, sources: DataFrame, documents: DataFrame) -> DataFrame:
    """(code, id) of rows that refer to rows of another research job, or name another document than their passage."""
    d = documents.select(F.col("id").alias("document_id"), F.col("research_job_id").alias("theirs"))
    c = chunks.select(F.col("id").alias("chunk_id"), F.col("research_job_id").alias("chunk_job"), F.col("document_id").alias("chunk_document"))
    apart = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    s = sources.select("id", "chunk_id", "document_id", "research_job_id")
    in_document, of_chunk = s.join(d, "document_id"), s.join(c, "chunk_id")
    row = lambda df, code, id_col: df.select(F.lit(code).alias("code"), F.col(id_col).cast("string").alias("id"))
    parts = [
        row(chunks.select("id", "document_id", "research_job_id").join(d, "document_id").where(apart("research_job_id", "theirs")), "CROSS_JOB_CHUNK", "id"),
        row(in_document.where(apart("research_job_id", "theirs")), "CROSS_JOB_DOCUMENT", "id"),
        row(of_chunk.where(apart("research_job_id", "chunk_job")), "CROSS_JOB_CHUNK_SOURCE", "id"),
        row(of_chunk.where(apart("document_id", "chunk_document")), "ORIGIN_DOCUMENT_MISMATCH", "id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def changes(old: DataFrame, new: DataFrame, key: str, by: str) -> DataFrame:
    """(by, created, reused, removed): what replacing a state by another does, told by keys alone."""
    both = old.select(key, F.col(by).alias("_o")).join(new.select(key, F.col(by).alias("_n")), key, "full_outer")
    kind = F.coalesce("_n", "_o").alias(by)
    return both.groupBy(kind).agg(F.count_if(F.col("_o").isNull()).alias("created"), F.count_if(F.col("_o").isNotNull() & F.col("_n").isNotNull()).alias("reused"), F.count_if(F.col("_n").isNull()).alias("removed"))


def coverage(nodes_: DataFrame, edges_: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """(name, have, total, ratio): of the nodes of a type, how many an edge of a type leaves (``out``) or reaches (``in``); 1.0 of none.

    ``wanted`` gives, under ``node type:direction``, the edge type and the name of the ratio.
    """
    parts = []
    for what, (edge_type, name) in wanted.items():
        node_type, direction = what.split(":")
        end = edges_.where(F.col("edge_type") == edge_type).select(F.col("src" if direction == "out" else "dst").alias("node_id")).distinct()
        n = nodes_.where(F.col("node_type") == node_type).join(end.withColumn("_has", F.lit(1)), "node_id", "left")
        parts.append(n.agg(F.count("_has").alias("have"), F.count("*").alias("total")).select(F.lit(name).alias("name"), "have", "total", F.when(F.col("total") == 0, 1.0).otherwise(F.round(F.col("have") / F.col("total"), 6)).alias("ratio")))
    return reduce(DataFrame.unionByName, parts)


def degrees(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """(node_id, node_type, outgoing, incoming); ends are counted before they are joined, so hubs are no hot keys."""
    out = edges_.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("outgoing"))
    into = edges_.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("incoming"))
    return nodes_.select("node_id", "node_type").join(out, "node_id", "left").join(into, "node_id", "left").fillna(0, ["outgoing", "incoming"])
