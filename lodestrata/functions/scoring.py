"""Numeric expressions of ranking and evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0, null where the lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(F.lit(0.0)))


def seed_score(similarity: Column, rank: Column, weight: float = 0.85) -> Column:
    """Similarity and search rank blended."""
    return weight * (similarity + 1) / 2 + (1 - weight) / F.log2(rank + 1)


def priority(relevance: Column, depth: Column, penalty: float = 0.05) -> Column:
    return relevance - penalty * depth


def bm25(tf: Column, df: Column, n: Column, length: Column, mean_length: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


def dcg(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """``a / b``; ``empty`` where ``b`` is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(empty))
