"""The registered queries of this subpackage, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import boilerplate, garbled, leakage, packing, reading_level, repeated_lines, residue, splitting
from lodestrata.sources.tables import spread
from lodestrata.sources.tables import table as _table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of one small file over all cores; larger ones as they are stored."""
    return spread(_table(spark, sf_dir, name))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.garbled_fields(table(spark, sf_dir, "crawled_pages")).select("page_id", "field_name")


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.garbled_fields(table(spark, sf_dir, "crawled_pages"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.furniture_lines(table(spark, sf_dir, "crawled_pages"))


def p2_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.articles(table(spark, sf_dir, "crawled_pages"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, sf_dir, "crawled_pages"))


def p3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(table(spark, sf_dir, "crawled_pages"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_fields(table(spark, sf_dir, "crawled_pages")).select("page_id", "field_name")


def p4_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_fields(table(spark, sf_dir, "crawled_pages")).groupBy("field_name", "residue_kind").agg(F.count("*").alias("fields"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_records(table(spark, sf_dir, "crawled_pages"), table(spark, sf_dir, "knowledge_chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(_pieces(spark, sf_dir))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_containers"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).where((F.col("n_pieces") > 1) & (F.col("piece_no") == 0)).select("container_kind", "doc_id")


def p6_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.container_fill(_placed(spark, sf_dir), table(spark, sf_dir, "pack_containers"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where((F.col("lang") == "en") & (F.col("n_chars") >= 400))
    return reading_level.reading_levels(docs, table(spark, sf_dir, "reading_samples")).select("doc_id", "reading_level")


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where((F.col("lang") == "en") & (F.col("n_chars") >= 400))
    levels = reading_level.reading_levels(docs, table(spark, sf_dir, "reading_samples"))
    return levels.join(docs.select("doc_id", "source", "n_chars"), "doc_id").groupBy("source", "reading_level").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_restored, p2_found, p2_articles, p3_found, p3_pages, p4_found, p4_kinds, p5_found, p5_pieces, p6_found, p6_assignments, p6_fill, p7_found, p7_leaks, p8_found, p8_profile)}

ORACLE_SQL: dict[str, str] = {
    "p3_found": r"""
WITH base AS (
  SELECT id, nullif(regexp_extract(normalized_url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '') AS site, text_content FROM crawled_pages
), sizes AS (SELECT site, count(*) AS n FROM base WHERE site IS NOT NULL GROUP BY site),
parts AS (SELECT id, site, string_split(text_content, chr(10)) AS ls FROM base WHERE site IS NOT NULL AND text_content IS NOT NULL),
lines AS (
  SELECT id, site, i AS line_no, trim(regexp_replace(regexp_replace(lower(ls[i]), '[0-9]+', '0', 'g'), '[ \t\r]+', ' ', 'g'), ' ') AS l
  FROM (SELECT id, site, ls, unnest(range(1, len(ls) + 1)) AS i FROM parts)
), counted AS (SELECT site, l, count(DISTINCT id) AS n FROM lines WHERE length(regexp_replace(l, '[^\p{L}]', '', 'g')) >= 3 GROUP BY site, l)
SELECT lines.id AS page_id, CAST(line_no AS INTEGER) AS line_no
FROM lines JOIN counted USING (site, l) JOIN sizes USING (site) WHERE counted.n >= 5 AND counted.n >= 0.05 * sizes.n""",
    "p5_found": r"""
WITH texts AS (
  SELECT 'page' AS record_kind, id AS record_id, text_content AS t FROM crawled_pages
  UNION ALL SELECT 'chunk', id, text FROM knowledge_chunks)
SELECT record_kind, record_id,
  CASE WHEN list_max(list_transform(string_split_regex(t, '[ \t\r\n.!?。！？]'), lambda x: length(x))) > 2600 THEN 'forced' ELSE 'natural' END AS cut_kind
FROM texts WHERE length(t) > 2600""",
    "p6_found": """
SELECT container_kind, doc_id FROM documents JOIN pack_containers ON strlen(text) + 1 > capacity_tokens""",
    "p7_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(replace(replace(text, chr(173), ''), chr(8203), '')), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(replace(replace(item_text, chr(173), ''), chr(8203), '')), '[\p{L}\p{N}]+') AS w FROM eval_items),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12)),
dg AS (SELECT doc_id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
