"""Passages: sections and chunks of texts, canonical passages with all their occurrences, incremental upkeep, audits."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import text as T
from lodestrata.operators.dedup import first_of

_SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9])")


def _sections(text: Column, title: Column) -> Column:
    """array of (no, heading, body) of the blocks between blank lines, found within the row.

    A block of one line that begins with ``# `` or ``## `` sets the heading; so does the first line of a longer block
    if it begins with ``# ``. The title stands before the first heading.
    """
    edge = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    blocks = F.filter(F.transform(F.split(F.regexp_replace(text, "\r", ""), r"\n\s*\n"), edge), lambda b: b != "")
    one = lambda b: ~b.contains("\n") & b.rlike(r"^##? ")
    head = lambda b: b.contains("\n") & b.startswith("# ")
    own = lambda b: F.trim(F.ltrim(F.regexp_extract(b, r"^([^\n]*)", 1), F.lit("# ")))
    parts = F.transform(blocks, lambda b, i: F.struct(i.alias("no"), F.when(one(b) | head(b), own(b)).alias("heading"), F.when(one(b), F.lit("")).when(head(b), edge(F.regexp_replace(b, r"^[^\n]*\n", ""))).otherwise(b).alias("body")))
    empty = F.struct(F.coalesce(title, F.lit("")).alias("heading"), F.array().cast("array<struct<no:int,heading:string,body:string>>").alias("out"))
    folded = F.aggregate(parts, empty, lambda acc, p: F.struct(F.coalesce(p["heading"], acc["heading"]).alias("heading"), F.concat(acc["out"], F.array(F.struct(p["no"].alias("no"), F.coalesce(p["heading"], acc["heading"]).alias("heading"), p["body"].alias("body")))).alias("out")), lambda acc: acc["out"])
    return F.filter(folded, lambda p: p["body"] != "")


def sections(docs: DataFrame, *, id_col: str, text_col: str, title_col: str) -> DataFrame:
    """(id, block_no, heading, body): the blocks of each text under the heading in force; null and empty texts have none."""
    return docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.explode(_sections(F.col(text_col), F.col(title_col))).alias("s")).select("id", F.col("s.no").alias("block_no"), "s.heading", "s.body")


def units(sections_: list[tuple[str, str]], target: int, most: int) -> Iterator[tuple[str, list[str]]]:
    """(heading, words) of what is not divided further: blocks of up to ``target`` words, the sentences of longer ones, and runs of ``most`` words of longer sentences."""
    for heading, body in sections_:
        words = body.split()
        if len(words) <= target:
            yield heading, words
            continue
        for sentence in _SENTENCE_END.split(body):
            words = sentence.split()
            for i in range(0, len(words), most):
                yield heading, words[i:i + most]


def pack_units(parts: list[tuple[str, list[str]]], target: int, most: int, overlap: int, least: int) -> list[tuple[str, list[str]]]:
    """(heading, words) of passages of about ``target`` and never more than ``most`` words.

    A passage ends where the next unit would not fit or stands under another heading; under the same one the next
    passage repeats the last ``overlap`` words, if there is room. What reaches ``most`` ends without being repeated. A last passage of
    fewer than ``least`` words joins the one before under the same heading if both fit.
    """
    out: list[tuple[str, list[str]]] = []
    now: list[str] = []
    under = ""
    for heading, words in parts:
        same = heading == under
        if now and same and len(now) + len(words) <= target:
            now += words
        else:
            again: list[str] = []
            if now:
                out.append((under, now))
                again = now[max(0, len(now) - overlap):] if same and overlap else []
            now = [*again, *words] if len(again) + len(words) <= most else list(words)
        under = heading
        if len(now) >= most:
            out.append((under, now))
            now = []
    if now:
        out.append((under, now))
    if len(out) > 1 and len(out[-1][1]) < least and out[-1][0] == out[-2][0] and len(out[-1][1]) + len(out[-2][1]) <= most:
        (heading, last), (_, before) = out.pop(), out.pop()
        out.append((heading, before + last))
    return out


def chunks(docs: DataFrame, *, id_col: str, text_col: str, title_col: str, target: int = 120, most: int = 160, overlap: int = 20, least: int = 20) -> DataFrame:
    """(id, chunk_no, heading, body, words): the passages of each text, in order; lengths are in words between blanks.

    Rows are independent: sections are found by expressions, and only the packing of one row's units is sequential.
    """
    if not 0 <= overlap < target <= most or not 0 <= least <= target:
        raise ValueError("0 <= overlap < target <= most and 0 <= least <= target must hold")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            packed = [pack_units(list(units([(s["heading"], s["body"]) for s in rows], target, most)), target, most, overlap, least) for rows in pdf["s"]]
            out = pd.DataFrame({"id": pdf["id"].repeat([len(p) for p in packed]), "chunk_no": [k for p in packed for k in range(len(p))], "heading": [h for p in packed for h, _ in p], "body": [" ".join(w) for p in packed for _, w in p], "words": [len(w) for p in packed for _, w in p]})
            yield out.astype({"chunk_no": "int32", "words": "int32"})

    rows = docs.where(F.length(text_col) > 0).select(F.col(id_col).cast("long").alias("id"), _sections(F.col(text_col), F.col(title_col)).alias("s")).where(F.size("s") > 0)
    return rows.mapInPandas(run, "id long, chunk_no int, heading string, body string, words int")


def canonical(passages: DataFrame, group: str) -> DataFrame:
    """(group, text_hash, canonical_id, occurrences): one canonical passage for each text of a group; all passages with it are its occurrences."""
    return passages.groupBy(group, "text_hash").agg(F.min("id").alias("canonical_id"), F.count("*").alias("occurrences"))


def vector_ids(passages: DataFrame, group: str) -> DataFrame:
    """(id, vector_key): a name-based UUID of group and text hash, the same wherever it is computed."""
    return passages.select("id", T.name_uuid(T.NAMESPACE_URL, F.concat(F.col(group), F.lit(":"), F.col("text_hash"))).alias("vector_key"))


def incremental(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, action) of two states (key, hash): added, changed, removed or skipped."""
    both = old.withColumnRenamed("hash", "old").join(new.withColumnRenamed("hash", "new"), "key", "full_outer")
    action = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("skipped")
    return both.select("key", action.alias("action"))


def orphans(chunks_: DataFrame, sources: DataFrame) -> DataFrame:
    """(id) of passages no occurrence names."""
    return chunks_.select("id").join(sources.select(F.col("chunk_id").alias("id")), "id", "left_anti")


def rehomed(chunks_: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, document_id, source_id): passages whose own document no longer names them, with the first occurrence that still does."""
    own = sources.select(F.col("chunk_id").alias("id"), "document_id").distinct()
    lost = chunks_.select("id", "document_id").join(own, ["id", "document_id"], "left_anti").select("id")
    first = first_of(sources.select(F.col("chunk_id").alias("id"), F.col("document_id"), F.col("id").alias("source_id")), ["id"], ["source_id"])
    return lost.join(first, "id")


def upkeep(chunks_: DataFrame, sources: DataFrame, removed: DataFrame) -> DataFrame:
    """(id, action, new_document_id) of each passage once the documents ``removed`` (document_id) are taken out.

    Their occurrences go with them. A passage whose own document still names it is kept; one that others still name is
    rehomed to the first of these; one that nobody names is pruned.
    """
    left = sources.join(removed.select("document_id").distinct(), "document_id", "left_anti").select(F.col("chunk_id").alias("id"), "document_id", F.col("id").alias("source_id"))
    c = chunks_.select("id", F.col("document_id").alias("own"))
    first = left.groupBy("id").agg(F.min_by("document_id", "source_id").alias("first"))
    own = left.select("id", F.col("document_id").alias("own"), F.lit(True).alias("_kept")).distinct()
    j = c.join(own, ["id", "own"], "left").join(first, "id", "left")
    action = F.when(F.col("_kept"), "kept").when(F.col("first").isNotNull(), "rehomed").otherwise("pruned")
    return j.select("id", action.alias("action"), F.when(action == "rehomed", F.col("first")).alias("new_document_id"))


def audit(chunks_: DataFrame, sources: DataFrame, documents: DataFrame) -> DataFrame:
    """(issue, n): what does not fit between passages, occurrences and documents."""
    c, s, d = chunks_.select(F.col("id").alias("chunk_id"), "vector_id"), sources.select("chunk_id", "document_id", "chunk_index"), documents.select(F.col("id").alias("document_id"))
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("issue"), "n")
    parts = [
        count("passage without occurrence", c.join(s, "chunk_id", "left_anti")),
        count("occurrence without passage", s.join(c, "chunk_id", "left_anti")),
        count("occurrence without document", s.join(d, "document_id", "left_anti")),
        count("passage without vector", c.where("vector_id IS NULL")),
        count("repeated position", s.groupBy("document_id", "chunk_index").count().where("count > 1")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def adjacent(sources: DataFrame) -> DataFrame:
    """(document_id, gaps): documents whose occurrences leave out an index."""
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    step = F.col("chunk_index") - F.lag("chunk_index").over(w)
    return sources.select("document_id", step.alias("step")).groupBy("document_id").agg(F.count_if(F.col("step") > 1).alias("gaps"))
