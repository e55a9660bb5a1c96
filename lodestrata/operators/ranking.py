"""Ranks, top-k and fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def positions(df: DataFrame, group: Sequence[str], slice_: Column, order: Sequence[Column | str], name: str, *, descending: bool = False, total: str | None = None) -> DataFrame:
    """``name``: the exact position, from 1, of each row in its group.

    ``slice_`` must be monotonic in the first term of ``order``. Rows are sorted within (group, slice); the slices before
    are added up from a table of counts. A group that holds a third of all rows is thus ranked by many tasks.
    """
    cut = df.withColumn("_slice", slice_)
    counts = cut.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
    by = Window.partitionBy(*group).orderBy(F.col("_slice").desc() if descending else F.col("_slice"))
    ahead = counts.select(*group, "_slice", F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"), F.sum("_n").over(Window.partitionBy(*group)).alias("_all"))
    ranked = cut.withColumn("_rn", F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(*order))).join(ahead, [*group, "_slice"])
    out = ranked.withColumn(name, F.col("_rn") + F.col("_ahead"))
    if total:
        out = out.withColumn(total, F.col("_all"))
    return out.drop("_slice", "_rn", "_ahead", "_all")


def top(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank; Spark cuts each map task's groups to ``k`` before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def fuse(rankings: Sequence[tuple[DataFrame, str, float]], key: Sequence[str], k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion: (key, rrf, one rank column for each ranking; null where an item is not ranked)."""
    out: DataFrame | None = None
    for df, rank, _ in rankings:
        part = df.select(*key, rank)
        out = part if out is None else out.join(part, list(key), "full_outer")
    score = sum((F.coalesce(F.lit(weight) / (k + F.col(rank)), F.lit(0.0)) for _, rank, weight in rankings), F.lit(0.0))
    return out.withColumn("rrf", score)


def capped(df: DataFrame, group: Sequence[str], within: str, order: Sequence[Column | str], cap: int, k: int) -> DataFrame:
    """At most ``cap`` rows of one ``within`` and ``k`` rows of each group, in order; ``position`` from 1."""
    few = top(df, [*group, within], order, cap, "_w").drop("_w")
    return top(few, group, order, k, "position")
