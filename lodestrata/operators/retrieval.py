"""Lexical and dense retrieval of passages, fused, capped and expanded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import scoring, text
from lodestrata.operators.ranking import capped, fuse, top
from lodestrata.sources.checkpoints import cut

#: Queries multiplied at once with the vectors of a task.
QUERY_BLOCK = 2_000
MOST_QUERY_TOKENS = 32


def query_terms(queries: DataFrame, *, id_col: str, text_col: str, group_col: str) -> DataFrame:
    """(query_id, grp, token): the distinct tokens among the first 32 of each query."""
    tokens = F.array_distinct(F.slice(text.tokens(F.col(text_col)), 1, MOST_QUERY_TOKENS))
    return queries.select(F.col(id_col).alias("query_id"), F.col(group_col).alias("grp"), F.explode(tokens).alias("token"))


def lexical_index(passages: DataFrame, terms: DataFrame, weights: dict[str, int]) -> DataFrame:
    """(passage_id, grp, document_id, length, distinct, hits): what the queries of a group can find in its passages.

    A passage's words are those of its fields, each field as often as its weight says. They are cut into tokens once;
    of these only the ones some query of the group asks for are kept, as (token, tf), and the result is written to the
    shared folder: statistics and both rankings come from it. Passages of groups without a query are left out.
    """
    asked = terms.groupBy("grp").agg(F.collect_set("token").alias("asked"))  # at most 32 for each query
    fields = F.concat_ws(" ", *[F.col(c) for c, w in weights.items() for _ in range(w)])
    cut_up = passages.join(asked, "grp").select("passage_id", "grp", "document_id", "asked", text.tokens(fields).alias("tokens"))
    held = cut_up.select("passage_id", "grp", "document_id", F.size("tokens").alias("length"), F.size(F.array_distinct("tokens")).alias("distinct"), F.filter("tokens", lambda t: F.array_contains("asked", t)).alias("held"))
    counted = F.transform(F.array_distinct("held"), lambda t: F.struct(t.alias("token"), F.size(F.filter("held", lambda x: x == t)).alias("tf")))
    return cut(held.select("passage_id", "grp", "document_id", "length", "distinct", counted.alias("hits")))


def scored(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, passage_id, document_id, score, similarity) of the passages that hold a token of a query of their group.

    ``score`` is BM25 by the statistics of what the group may search; ``similarity`` is the cosine of the sets of tokens,
    which stands in for a model's vectors (these may be plugged in instead).
    """
    sizes = index.groupBy("grp").agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
    tf = index.select("passage_id", "grp", "document_id", "length", "distinct", F.explode("hits").alias("h")).select("passage_id", "grp", "document_id", "length", "distinct", "h.token", "h.tf")
    df = tf.groupBy("grp", "token").agg(F.count("*").alias("df"))
    # queries with the statistics of their tokens are few; passages meet them in one join
    size_q = terms.groupBy("query_id").agg(F.count("*").alias("nq"))
    asked = terms.join(df, ["grp", "token"]).join(sizes, "grp").join(size_q, "query_id")
    met = tf.join(asked, ["grp", "token"])
    w = scoring.bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("length"), F.col("mean_length"))
    agg = met.groupBy("query_id", "passage_id", "document_id").agg(F.sum(w).alias("score"), (F.count("*") / F.sqrt(F.first("nq") * F.first("distinct"))).alias("similarity"))
    return agg.select("query_id", "passage_id", "document_id", F.round("score", 9).alias("score"), F.round("similarity", 9).alias("similarity"))


def search(index: DataFrame, terms: DataFrame, mode: str = "hybrid", *, candidates: int = 50, cap: int = 2, k: int = 8, rrf_k: int = 60) -> DataFrame:
    """(query_id, position, passage_id, document_id, rrf, a rank for each list): the lists of a mode fused, at most ``cap`` passages of a document.

    ``mode`` is hybrid, lexical or dense; a single list goes through the fusion as well.
    """
    lists = {"hybrid": ("lexical", "dense"), "lexical": ("lexical",), "dense": ("dense",)}[mode]
    hits = scored(index, terms)
    by = {"lexical": "score", "dense": "similarity"}
    ranked = [top(hits.select("query_id", "passage_id", "document_id", by[x]), ["query_id"], [F.col(by[x]).desc(), "passage_id"], candidates, f"{x}_rank") for x in lists]
    fused = fuse([(r, f"{x}_rank", 1.0) for r, x in zip(ranked, lists, strict=True)], ["query_id", "passage_id", "document_id"], rrf_k).withColumn("rrf", F.round("rrf", 9))
    best = capped(fused, ["query_id"], "document_id", [F.col("rrf").desc(), "passage_id"], cap, k)
    return best.select("query_id", "position", "passage_id", "document_id", "rrf", *[f"{x}_rank" for x in lists])


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str, vector_col: str) -> DataFrame:
    """(query_id, id, similarity, rank): the ``k`` nearest vectors of each query by cosine, exactly, the query itself left out.

    Queries are a stated set, taken in blocks that tasks hold as a matrix; each task keeps its best ``k`` for each query,
    so that what is shuffled does not grow with the vectors of a task. Null, empty and zero vectors match nothing.
    """
    spark = vectors.sparkSession
    side = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.size("v") > 0)
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.size("v") > 0)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    schema = "query_id long, id long, similarity double"
    parts: DataFrame | None = None
    for b in range(blocks):
        rows = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).orderBy("id").collect()
        q = np.array([r[1] for r in rows], float).reshape(len(rows), -1)
        norm = np.linalg.norm(q, axis=1)
        held = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64)[norm > 0], q[norm > 0] / norm[norm > 0, None]))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, matrix = held.value
            best_s, best_i = np.full((len(ids), k), -2.0), np.full((len(ids), k), -1, np.int64)
            for batch in batches:
                lists = batch.column("v")
                sizes = np.diff(np.asarray(lists.offsets))
                fits = sizes == (matrix.shape[1] if len(ids) else -1)
                if not fits.any():
                    continue
                own = np.asarray(batch.column("id"))[fits]
                v = np.asarray(lists.filter(pa.array(fits)).flatten()).reshape(len(own), -1)
                n = np.linalg.norm(v, axis=1)
                own, v = own[n > 0], v[n > 0] / n[n > 0, None]
                s = np.concatenate([best_s, np.where(ids[:, None] == own[None, :], -2.0, matrix @ v.T)], axis=1)
                i = np.concatenate([best_i, np.broadcast_to(own, (len(ids), len(own)))], axis=1)
                order = np.lexsort((i, -np.round(s, 9)), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            good = best_s > -1.5
            if good.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, good.sum(1))), pa.array(best_i[good]), pa.array(best_s[good])], ["query_id", "id", "similarity"])

        found = side.mapInArrow(run, schema)
        parts = found if parts is None else parts.unionByName(found)
    return top(parts.withColumn("similarity", F.round("similarity", 6)), ["query_id"], [F.col("similarity").desc(), "id"], k)


def neighbours(occurrences: DataFrame, window: int = 1) -> DataFrame:
    """(id, neighbour_id, distance): other occurrences of the same document whose index is within ``window``.

    The range condition becomes an equality: each occurrence is offered to the few indices around it.
    """
    around = F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window)).alias("chunk_index")
    left = occurrences.select("id", "document_id", F.col("chunk_index").alias("own"), around)
    right = occurrences.select(F.col("id").alias("neighbour_id"), "document_id", "chunk_index")
    return left.join(right, ["document_id", "chunk_index"]).where("id <> neighbour_id").select("id", "neighbour_id", (F.col("chunk_index") - F.col("own")).alias("distance"))
