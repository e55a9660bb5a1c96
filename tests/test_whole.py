"""Queries that do the whole job where SQL covers a part of it."""

import hashlib

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import crawl
from lodestrata.plans import registry

TEXTS = ["Plain  ASCII text.", "Straße  der Stadt. ", "STRASSE der Stadt", "ΟΔΟΣ ΣΊΣΥΦΟΣ", "οδος σίσυφος", "Привет,　МИР", "привет, мир", "東京　タワー。", "ﬁn İstanbul ŉ\x1cx\x85y", "  ", "", None]


def _claim(t):
    return " ".join(t.split()).rstrip(". ").casefold()


def _run(spark, tmp_path, query, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    return registry.queries()[query](spark, str(tmp_path)).collect()


def test_content_hashes_of_all_scripts(spark, tmp_path):
    got = dict(_run(spark, tmp_path, "content_hashes_all", "crawled_pages", list(enumerate(TEXTS)), "id long, text_content string"))
    assert got == {i: hashlib.sha256(" ".join(t.split()).casefold().encode()).hexdigest() for i, t in enumerate(TEXTS) if t is not None}


def test_fingerprints_of_all_scripts(spark, tmp_path):
    rows = [(i, t, f"http://a/{i}") for i, t in enumerate(TEXTS)]
    got = {r.id: (r.fingerprint, r.claim_form) for r in _run(spark, tmp_path, "document_fingerprints_all", "knowledge_documents", rows, "id long, title string, source_url string")}
    assert got == {i: (hashlib.sha256(f"{t or ''}\n{u}".encode()).hexdigest(), None if t is None else _claim(t)) for i, t, u in rows}


def test_claims_of_all_scripts_are_merged(spark, tmp_path):
    rows = [(i, "j", t) for i, t in enumerate(TEXTS)]
    want = {}
    for i, _, t in rows:
        if t is not None:
            want.setdefault(_claim(t), []).append(i)
    got = {r.form: (r.kept, r.members) for r in _run(spark, tmp_path, "claim_dedup_all", "knowledge_documents", rows, "id long, research_job_id string, title string")}
    assert got == {k: (min(v), len(v)) for k, v in want.items()}
    assert (1, 2) in got.values()


def test_casefold_of_every_letter(spark):
    cs = [chr(c) for c in range(0x20, 0x20000) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c)]
    got = spark.createDataFrame([(c, c.casefold()) for c in cs], "c string, want string").where(T.casefold(F.col("c")) != F.col("want"))
    assert [r.c for r in got.collect()] == []


LINKS = "id long, crawl_job_id string, normalized_target_url string, target_depth int, relevance_score double"


def test_unscored_links_wait_in_the_frontier(spark):
    links = spark.createDataFrame([(1, "j", "a", 1, None), (2, "j", "b", 1, 0.3), (3, "j", "c", 1, None), (4, "j", "c", 1, 0.7), (5, "j", None, 1, 0.9)], LINKS)
    ranks = {r.url: (r.best_first, r.worst_first, r.discovered, r.frontier) for r in crawl.frontier_ranks(links).collect()}
    assert ranks == {"c": (1, 3, 3, 3), "b": (2, 2, 2, 3), "a": (3, 1, 1, 3)}


def test_fifo_jobs_go_by_discovery(spark):
    rows = [(10 * i + (job == "g"), job, f"u{i}", 1, s) for i, s in enumerate([0.1, None, 0.9, 0.5]) for job in ("f", "g")]
    jobs = spark.createDataFrame([("f", "fifo"), ("g", "intelligent")], "id string, crawl_mode string")
    got = {}
    for r in crawl.frontier_order(spark.createDataFrame(rows, LINKS), 0.5, jobs).orderBy("position").collect():
        got.setdefault(r.crawl_job_id, []).append((r.url, r.explore))
    assert got == {"f": [(f"u{i}", False) for i in range(4)], "g": [("u2", False), ("u1", True), ("u3", False), ("u0", False)]}


def test_seeds_without_a_score(spark, tmp_path):
    rows = [(1, "j", "http://a/x", 1, None), (2, "j", "http://b/x", 1, 0.9)]
    got = {r.url: (r.score, r.position) for r in _run(spark, tmp_path, "seed_selection_all", "discovered_links", rows, LINKS)}
    assert got == {"http://b/x": (round(0.85 * 0.95 + 0.15 / 1.5849625007, 6), 1), "http://a/x": (0.575, 2)}


def test_fusion_ranks_every_page(spark, tmp_path):
    rows = [(i, "j", i / 200, 1 - i / 200) for i in range(150)] + [(900, None, 0.5, None)]
    got = {r.id: (r.by_page, r.by_link) for r in _run(spark, tmp_path, "relevance_fusion", "crawled_pages", rows, "id long, crawl_job_id string, actual_page_relevance double, predicted_link_relevance double")}
    assert got == {i: (150 - i, i + 1) for i in range(150)} | {900: (1, None)}
