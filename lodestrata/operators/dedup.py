"""First-wins and latest-wins choices, set differences and idempotent merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_of(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """One row for each key: the first in ``order``. A row_number filter, which Spark turns into a partial top-1 before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


#: A key of more rows than this is joined apart: there is at most one such key for so many rows.
HOT_ROWS = 50_000


def attach(df: DataFrame, per_key: DataFrame, key: list[str], count: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with the columns of ``per_key``, one row for each key, of which ``count`` counts the rows of ``df``; a left join.

    Keys of more than ``hot_rows`` rows (a ``hot_rows``-th part of all rows at most) go to all tasks, and their rows stay
    where they are: for the join of the rest they get a key of their own each, as do rows without a key, so no task receives
    a hot key.
    """
    values = [c for c in per_key.columns if c not in key and c != count]
    hot = per_key.where(F.col(count) > hot_rows).select(*key, F.struct(*values).alias("_hot"))
    cold = per_key.where(F.col(count) <= hot_rows).select(*key, F.lit(0).cast("long").alias("_apart"), F.struct(*values).alias("_cold"))
    alone = F.col("_hot").isNotNull()
    for k in key:
        alone = alone | F.col(k).isNull()
    marked = df.join(F.broadcast(hot), key, "left").withColumn("_apart", F.when(alone, F.monotonically_increasing_id() + 1).otherwise(0))
    joined = marked.join(cold, [*key, "_apart"], "left").withColumn("_both", F.coalesce("_hot", "_cold"))
    return joined.select(*df.columns, *[F.col(f"_both.{c}").alias(c) for c in values])


def mark_duplicates(df: DataFrame, key: list[str], id_col: str) -> DataFrame:
    """``duplicate_of``: the smallest id of the same key, null for that row itself and where a key is null.

    The first id is found by an aggregate with partial sums and attached, so a key that a third of all rows share is
    neither sorted nor received by one task.
    """
    known = [F.col(k).isNotNull() for k in key]
    complete = known[0]
    for k in known[1:]:
        complete = complete & k
    first = df.where(complete).groupBy(*key).agg(F.min(id_col).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    joined = attach(df, first, key, "_n")
    return joined.withColumn("duplicate_of", F.when(F.col("_first") < F.col(id_col), F.col("_first"))).drop("_first")


def absent(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``old``: what an idempotent insert appends."""
    return new.join(old.select(*key), key, "left_anti")


def difference(expected: DataFrame, actual: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(key, issue) of what is missing, unexpected or different; both sides have unique keys."""
    digest = lambda df: df.select(*key, F.xxhash64(*values).alias("_h"), F.lit(True).alias("_here"))
    e, a = digest(expected).alias("e"), digest(actual).withColumnRenamed("_h", "_h2").withColumnRenamed("_here", "_there")
    both = e.join(a, key, "full_outer")
    issue = F.when(F.col("_there").isNull(), "missing").when(F.col("_here").isNull(), "unexpected").when(~F.col("_h").eqNullSafe(F.col("_h2")), "different")
    return both.select(*key, issue.alias("issue")).where(F.col("issue").isNotNull())


def latest(df: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """One row for each key: the last by ``by``, as an aggregate with partial maxima instead of a sort."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_row")).select(*key, "_row.*")


def page_with_total(df: DataFrame, order: list[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """``page_of`` with the number of all rows as ``total``."""
    return page_of(df, order, limit, offset).crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))  # one row


def page_of(df: DataFrame, order: list[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """A page of a listing: a bounded top-k, never a full sort in one task."""
    return df.orderBy(*order).offset(offset).limit(limit)
