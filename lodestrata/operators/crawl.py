"""Scheduling discovered links, ordering a frontier, pacing hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.urls import hostname, is_private_host
from lodestrata.operators.dedup import attach
from lodestrata.operators.ranking import positions, top
from lodestrata.sources.checkpoints import cut


def schedule_links(links: DataFrame, jobs: DataFrame) -> DataFrame:
    """(id, outcome): the first rule that turns a link away, or SCHEDULED.

    A link is a duplicate unless it is the first of its job to name the target; first ids come from an aggregate, not
    from a sort of all links to one target.
    """
    key = ["crawl_job_id", "normalized_target_url"]
    first = links.where("normalized_target_url IS NOT NULL").groupBy(*key).agg(F.min("id").alias("first_id"), F.count("*").alias("_n"))
    limits = jobs.select(F.col("id").alias("crawl_job_id"), "max_depth", "min_relevance_score")
    joined = attach(links.select("id", *key, "target_depth", "is_internal", "relevance_score"), first, key, "_n").join(limits, "crawl_job_id")
    outcome = (
        F.when(F.col("normalized_target_url").isNull(), "INVALID_URL")
        .when(F.col("id") > F.col("first_id"), "DUPLICATE_URL")
        .when(F.col("target_depth") > F.col("max_depth"), "DEPTH_LIMIT")
        .when(~F.col("is_internal"), "EXTERNAL")
        .when(F.col("relevance_score") < F.col("min_relevance_score"), "LOW_RELEVANCE")
        .otherwise("SCHEDULED")
    )
    return joined.select("id", outcome.alias("outcome"))


def scopes(jobs: DataFrame) -> DataFrame:
    """(crawl_job_id, root, allowed): the host a job starts at and the hosts it is allowed, none meaning all."""
    return jobs.select(F.col("id").alias("crawl_job_id"), hostname(F.col("start_url")).alias("root"), F.from_json("allowed_domains", "array<string>").alias("allowed"))


def in_scope(host: Column, root: Column, allowed: Column) -> Column:
    return (host == root) & ((F.size(allowed) == 0) | F.array_contains(allowed, host))


def schedule_outcomes(links: DataFrame, jobs: DataFrame) -> DataFrame:
    """(id, outcome): the first rule of the job's whole chain that turns a link away, or SCHEDULED.

    A target is a duplicate unless this is the first link of the job that names it, and if the job starts there. The
    relevance threshold holds for jobs in intelligent mode.
    """
    key = ["crawl_job_id", "normalized_target_url"]
    first = links.where("normalized_target_url IS NOT NULL").groupBy(*key).agg(F.min("id").alias("first_id"), F.count("*").alias("_n"))
    limits = scopes(jobs).join(jobs.select(F.col("id").alias("crawl_job_id"), "start_url", "max_depth", "min_relevance_score", "crawl_mode"), "crawl_job_id")
    l = attach(links.select("id", *key, "target_depth", "relevance_score"), first, key, "_n").withColumn("host", hostname(F.col("normalized_target_url"))).join(limits, "crawl_job_id")
    outcome = (
        F.when(F.col("normalized_target_url").isNull(), "INVALID_URL")
        .when((F.col("id") > F.col("first_id")) | (F.col("normalized_target_url") == F.col("start_url")), "DUPLICATE_URL")
        .when(F.col("target_depth") > F.col("max_depth"), "DEPTH_LIMIT")
        .when(is_private_host(F.col("host")), "SSRF_BLOCKED")
        .when(~F.col("host").eqNullSafe(F.col("root")), "EXTERNAL_DOMAIN_DISABLED")
        .when((F.size("allowed") > 0) & ~F.array_contains("allowed", F.col("host")), "DOMAIN_NOT_ALLOWED")
        .when((F.col("crawl_mode") == "intelligent") & (F.col("relevance_score") < F.col("min_relevance_score")), "LOW_RELEVANCE")
        .otherwise("SCHEDULED")
    )
    return l.select("id", outcome.alias("outcome"))


def unite_results(results: DataFrame, group: list[str], list_col: str) -> DataFrame:
    """(group, url, best_rank, title, first_id, lists): ranked lists of results (id, url, anchor_text) united by URL.

    Ranks are positions in a list by id; a list is one page's links. The first occurrence supplies the title.
    """
    w = Window.partitionBy(*group, list_col).orderBy("id")
    ranked = results.withColumn("rank", F.row_number().over(w))
    return ranked.groupBy(*group, "url").agg(F.min("rank").alias("best_rank"), F.min_by(F.coalesce("anchor_text", F.lit("")), "id").alias("title"), F.min("id").alias("first_id"), F.count_distinct(list_col).alias("lists"))


def seed_outcomes(candidates: DataFrame, group: str, cap: int, limit: int, before: DataFrame | None = None) -> DataFrame:
    """``outcome`` of candidates (group, url, host, score): SELECTED, DOMAIN_CAP for more than ``cap`` of a host, SEED_LIMIT for what comes after ``limit`` are taken.

    Both are bounded top-k choices; the others are told apart by the last candidate taken, so no task orders a whole group.
    ``before`` (group, host, taken) says how many of a host an earlier round took: these count against the cap.
    """
    host = F.coalesce("host", F.lit(""))
    order = [F.col("score").desc(), "url"]
    fits = top(candidates.withColumn("_h", host), [group, "_h"], order, cap, "_w")
    if before is not None:
        fits = fits.join(before.select(group, F.coalesce("host", F.lit("")).alias("_h"), "taken"), [group, "_h"], "left").where(F.col("_w") + F.coalesce("taken", F.lit(0)) <= cap).drop("taken")
    fits = fits.drop("_w", "_h")
    taken = top(fits, [group], order, limit, "position").select(group, "url", "score", "position")
    last = taken.where(F.col("position") == limit).select(group, F.col("score").alias("_s"), F.col("url").alias("_u"))
    j = candidates.join(taken.select(group, "url", "position"), [group, "url"], "left").join(last, group, "left")
    after = F.coalesce((F.col("score") < F.col("_s")) | ((F.col("score") == F.col("_s")) & (F.col("url") > F.col("_u"))), F.lit(False))
    return j.withColumn("outcome", F.when(F.col("position").isNotNull(), "SELECTED").when(after, "SEED_LIMIT").otherwise("DOMAIN_CAP")).drop("position", "_s", "_u")


def _frontier(links: DataFrame) -> DataFrame:
    """A target without any score waits with 0."""
    known = links.where("normalized_target_url IS NOT NULL")
    return known.groupBy("crawl_job_id", F.col("normalized_target_url").alias("url")).agg(F.min("target_depth").alias("depth"), F.coalesce(F.max("relevance_score"), F.lit(0.0)).alias("score"), F.min("id").alias("discovery"))


def frontier_ranks(links: DataFrame) -> DataFrame:
    """(crawl_job_id, url, score, best_first, worst_first, discovered, frontier): the orders in which a frontier may be left.

    Ranked in slices of the score or of discovery, so that no task has to sort the whole frontier of one job.
    """
    slices = _frontier(links).withColumn("slice", F.floor(F.col("score") * 64))
    best = positions(slices, ["crawl_job_id"], F.col("slice"), [F.col("score").desc(), "depth", "discovery", "url"], "best_first", descending=True)
    both = positions(best, ["crawl_job_id"], F.col("slice"), ["score", "depth", "discovery", "url"], "worst_first", total="frontier")
    found = positions(both, ["crawl_job_id"], F.floor(F.col("discovery") / 4096), ["discovery"], "discovered")
    return found.select("crawl_job_id", "url", "score", "best_first", "worst_first", "discovered", "frontier")


def frontier_order(links: DataFrame, exploration_rate: float, jobs: DataFrame | None = None) -> DataFrame:
    """(crawl_job_id, position, url, explore): the order in which a fixed frontier is left.

    Every k-th step, k = 1 / rate rounded half to even, explores: it takes the least relevant URL left, as long as more
    than one is. In closed form the w-th exploring step is at w k, the r-th other one at r + (r - 1) / (k - 1). URLs of
    one score leave in one order, by depth and discovery, whichever kind of step takes them: a score with A better and
    B worse URLs is left by the other steps if all of it comes before them, by the exploring ones if those use it up,
    and where both meet, its j-th URL leaves at j + A + B as soon as both have begun.
    With ``jobs``, those whose mode is not *intelligent* leave theirs by discovery and never explore.
    """
    k = max(1, round(1 / exploration_rate)) if exploration_rate > 0 else 1 << 30
    ranks = frontier_ranks(links).withColumn("scored", F.lit(True))
    if jobs is not None:
        modes = jobs.select(F.col("id").alias("crawl_job_id"), (F.col("crawl_mode") == "intelligent").alias("mode"))
        ranks = ranks.join(modes, "crawl_job_id", "left").withColumn("scored", F.coalesce("mode", F.lit(False)))
    ranks = cut(ranks)  # read twice
    per = ranks.groupBy("crawl_job_id", "score").agg((F.min("best_first") - 1).alias("better"), (F.min("worst_first") - 1).alias("worse"), F.count("*").alias("_n"))
    ranks = attach(ranks, per.withColumn("size", F.col("_n")), ["crawl_job_id", "score"], "_n")
    n, a, b = (F.col(c).cast("long") for c in ("frontier", "better", "worse"))
    j = F.col("best_first").cast("long") - a
    explores = F.floor((n - 1) / k).cast("long")
    steady = lambda r: F.least(r + F.floor((r - 1) / (k - 1)), n) if k > 1 else n
    meeting = F.when(steady(a + 1) < k * (b + 1), F.when(steady(a + j) < k * (b + 1), steady(a + j)).otherwise(j + a + b)).otherwise(F.when(k * (b + j) < steady(a + 1), k * (b + j)).otherwise(j + a + b))
    best_first = F.when(a + F.col("size") <= n - explores, steady(a + j)).when(b + F.col("size") <= explores, k * (b + j)).otherwise(meeting)
    position = F.when(F.col("scored"), best_first).otherwise(F.col("discovered")).cast("long")
    return ranks.select("crawl_job_id", position.alias("position"), "url", (F.col("scored") & (position % k == 0) & (position < n)).alias("explore"))


def compare_modes(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Yield and relevance of the pages by crawl mode."""
    j = jobs.select(F.col("id").alias("crawl_job_id"), "crawl_mode", "min_relevance_score")
    scored = pages.where("actual_page_relevance IS NOT NULL").select("crawl_job_id", "actual_page_relevance").join(j, "crawl_job_id")
    r = F.col("actual_page_relevance")
    agg = scored.groupBy("crawl_mode").agg(F.count("*").alias("pages"), F.count_if(r >= F.coalesce("min_relevance_score", F.lit(0.4))).alias("relevant"), F.avg(r).alias("mean"), F.count_if(r >= 0.6).alias("high"))
    return agg.select("crawl_mode", "pages", F.round(F.col("relevant") / F.col("pages"), 6).alias("relevant_yield"), F.round("mean", 6).alias("mean_relevance"), F.round(F.col("high") / F.col("pages"), 6).alias("high_hit_rate"))


def rate_gaps(pages: DataFrame, min_delay_ms: int) -> DataFrame:
    """Requests of a job to one host, and how many came sooner than the delay after the one before.

    Requests are put in order hour by hour; the first of an hour follows the last of the hour before it that has any.
    """
    key = ["crawl_job_id", "host"]
    seen = pages.where("crawled_at IS NOT NULL").select("id", "crawl_job_id", "crawled_at", hostname(F.col("normalized_url")).alias("host"), F.date_trunc("hour", "crawled_at").alias("hour"))
    hours = seen.groupBy(*key, "hour").agg(F.max("crawled_at").alias("last"))
    before = hours.select(*key, "hour", F.lag("last").over(Window.partitionBy(*key).orderBy("hour")).alias("before"))
    w = Window.partitionBy(*key, "hour").orderBy("crawled_at", "id")
    within = seen.withColumn("previous", F.lag("crawled_at").over(w)).join(before.withColumnRenamed("host", "h").withColumnRenamed("hour", "hr").withColumnRenamed("crawl_job_id", "j"), F.col("host").eqNullSafe(F.col("h")) & (F.col("hour") == F.col("hr")) & (F.col("crawl_job_id") == F.col("j")))
    gap = F.timestamp_diff("MILLISECOND", F.coalesce("previous", "before"), F.col("crawled_at"))
    return within.select(*key, gap.alias("gap")).groupBy(*key).agg(F.count("*").alias("requests"), F.count_if(F.col("gap") < min_delay_ms).alias("too_soon"), F.min("gap").alias("shortest_ms"))
