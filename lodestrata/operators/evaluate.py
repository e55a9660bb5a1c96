"""Quality of rankings, labels and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.scoring import dcg, ratio
from lodestrata.operators.ranking import positions


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, precision, mrr, ndcg, hit) of ``ranked`` (query_id, id, rank) against ``relevant`` (query_id, id, grade > 0).

    Precision divides by ``k`` even if fewer were found; the reciprocal rank looks at the whole ranking.
    """
    hits = ranked.join(relevant, ["query_id", "id"])
    got = hits.groupBy("query_id").agg(F.count_if(F.col("rank") <= k).alias("found"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, dcg(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias("gain"))
    w = Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "id")
    ideal = relevant.withColumn("r", F.row_number().over(w)).groupBy("query_id").agg(F.count("*").alias("wanted"), F.sum(F.when(F.col("r") <= k, dcg(F.col("grade"), F.col("r"))).otherwise(0.0)).alias("best"))
    j = ideal.join(got, "query_id", "left").fillna(0, ["found", "gain"])
    r = lambda c: F.round(c, 6)
    return j.select("query_id", r(F.col("found") / F.col("wanted")).alias("recall"), r(F.col("found") / F.lit(k)).alias("precision"), r(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), r(F.coalesce(ratio(F.col("gain"), F.col("best")), F.lit(0.0))).alias("ndcg"), (F.col("found") > 0).alias("hit"))


def confusion(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def label_metrics(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) from a confusion matrix; an empty side counts as 1 where nothing was to be found, else 0."""
    gold = matrix.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)).alias("right"))
    told = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("told"))
    j = gold.join(told, "label", "full_outer").fillna(0, ["support", "right", "told"])
    p = F.when(F.col("told") > 0, F.col("right") / F.col("told")).otherwise(F.when(F.col("support") == 0, 1.0).otherwise(0.0))
    r = F.when(F.col("support") > 0, F.col("right") / F.col("support")).otherwise(F.when(F.col("told") == 0, 1.0).otherwise(0.0))
    d = j.withColumn("p", p).withColumn("r", r)
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return d.select("label", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f1, 6).alias("f1"), "support")


def medians(df: DataFrame, group: list[str], value: str, width: float) -> DataFrame:
    """(group, median) of the known values, exactly: the mean of the one or two rows in the middle.

    Values are ranked in slices of ``width``, so no task holds a whole group.
    """
    known = df.where(F.col(value).isNotNull()).select(F.struct(*group).alias("_g"), *group, value)  # a struct: null groups stay
    ranked = positions(known, ["_g"], F.floor(F.col(value) / width), [value], "_at", total="_of")
    middle = ranked.where((F.col("_at") * 2 >= F.col("_of")) & (F.col("_at") * 2 <= F.col("_of") + 2))
    return middle.groupBy(*group).agg(F.avg(value).alias("median"))


def distribution(df: DataFrame, group: list[str], value: str, width: float = 1 / 64) -> DataFrame:
    """Number, mean, exact median and range of the known values of each group; a group without any keeps its row."""
    v = F.col(value)
    plain = df.groupBy(*group).agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"))
    m = medians(df, group, value, width).select(*[F.col(g).alias(f"_{g}") for g in group], F.round("median", 6).alias("median"))
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    return plain.join(m, same, "left").select(*group, "n", "mean", "median", "least", "most")


def macro(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, mean of each column): every query counts alike."""
    return metrics.agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in columns])


def retrieval_run(ranked: DataFrame, relevant: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, mrr, relevant_sources, source_recall, retrieved, retrieved_sources) of the first ``k`` of ``ranked`` (query_id, id, rank).

    ``relevant`` (query_id, id), ``sources`` (id, source). A source is relevant if it holds a relevant item. Reciprocal
    ranks are those within ``k``.
    """
    first = ranked.where(F.col("rank") <= k).select("query_id", "id", "rank").join(relevant.select("query_id", "id", F.lit(True).alias("hit")), ["query_id", "id"], "left").join(sources, "id")
    wanted = relevant.join(sources, "id")
    good = wanted.select("query_id", "source", F.lit(True).alias("good")).distinct()
    got = first.join(good, ["query_id", "source"], "left").groupBy("query_id").agg(
        F.count("hit").alias("found"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("at"), F.count_distinct(F.when(F.col("good"), F.col("source"))).alias("relevant_sources"), F.count("*").alias("retrieved"), F.count_distinct("source").alias("retrieved_sources")
    )
    all_ = wanted.groupBy("query_id").agg(F.count("*").alias("items"), F.count_distinct("source").alias("all_sources"))
    j = got.join(all_, "query_id", "left")
    r = lambda a, b: F.round(F.coalesce(F.col(a) / F.col(b), F.lit(0.0)), 6)
    return j.select("query_id", r("found", "items").alias("recall"), F.round(F.coalesce(1 / F.col("at"), F.lit(0.0)), 6).alias("mrr"), "relevant_sources", r("relevant_sources", "all_sources").alias("source_recall"), "retrieved", "retrieved_sources")


def label_summary(matrix: DataFrame) -> DataFrame:
    """(labels, macro_f1, accuracy) of a confusion matrix."""
    f1 = label_metrics(matrix).agg(F.count("*").alias("labels"), F.round(F.avg("f1"), 6).alias("macro_f1"))
    a = matrix.agg(F.round(F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("accuracy"))
    return f1.crossJoin(a)  # one row each


def similar_sets(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, overlap): pairs of sets (id, s) whose Jaccard overlap is ``least`` or more, also of two empty ones.

    Prefix filtering: with its words ordered by how few sets have them, a pair can reach ``least`` only if it shares one
    of the first ``size - ceil(least * size) + 1`` words of both. Common words thus bring no pairs together.
    """
    count = sets.select(F.explode("s").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    each = sets.select("id", F.size("s").alias("size"), F.explode("s").alias("w")).join(count, "w")
    order = F.transform(F.array_sort(F.collect_list(F.struct("n", "w"))), lambda x: x["w"])
    sorted_ = each.groupBy("id", "size").agg(order.alias("s"))  # one set's words
    prefix = (F.col("size") - F.ceil(F.lit(least) * F.col("size")) + 1).cast("int")
    p = sorted_.select("id", "size", "s", F.explode(F.slice("s", 1, prefix)).alias("w"))
    left, right = p.select(F.col("id").alias("a"), F.col("s").alias("x"), "w"), p.select(F.col("id").alias("b"), F.col("s").alias("y"), "w")
    pairs = left.join(right, "w").where("a < b").where((F.size("x") >= least * F.size("y")) & (F.size("y") >= least * F.size("x"))).dropDuplicates(["a", "b"])
    both = F.size(F.array_intersect("x", "y"))
    found = pairs.select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("overlap")).where(F.col("overlap") >= least)
    none = sets.where(F.size("s") == 0).select("id")
    first = none.agg(F.min("id").alias("a"))  # the empty ones are one class; each is paired with its first
    return found.unionByName(none.withColumnRenamed("id", "b").crossJoin(first).where("a < b").select("a", "b", F.lit(1.0).alias("overlap")))


def set_accuracy(expected: DataFrame, actual: DataFrame, key: str, item: str) -> DataFrame:
    """(sets, accuracy): for what share of the keys both sides hold exactly the same items; rows are distinct."""
    both = expected.select(key, item, F.lit(1).alias("_e")).join(actual.select(key, item, F.lit(1).alias("_a")), [key, item], "full_outer")
    per = both.groupBy(key).agg((F.count("_e") == F.count("*")) & (F.count("_a") == F.count("*")))
    same = per.toDF(key, "same")
    return same.agg(F.count("*").alias("sets"), F.round(F.avg(F.col("same").cast("int")), 6).alias("accuracy"))


def novelty(events: DataFrame, key: str, item: str, step: str) -> DataFrame:
    """(key, step, items, fresh): distinct items of each step, and how many of them no earlier step of the key had.

    First steps come from an aggregate; no step's set is gathered.
    """
    first = events.groupBy(key, item).agg(F.min(step).alias("first"))
    per = events.select(key, step, item).distinct().join(first, [key, item])
    return per.groupBy(key, step).agg(F.count("*").alias("items"), F.count_if(F.col("first") == F.col(step)).alias("fresh"))


def streaks(df: DataFrame, key: str, step: str, reset: str) -> DataFrame:
    """``streak``: how many steps in a row, up to this one, did not reset."""
    w = Window.partitionBy(key).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    run = df.withColumn("_run", F.sum(F.col(reset).cast("int")).over(w))
    inner = Window.partitionBy(key, "_run").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return run.withColumn("streak", F.sum((~F.col(reset)).cast("int")).over(inner)).drop("_run")
