"""Connected components and traversal by rounds of joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.dedup import HOT_ROWS, attach
from lodestrata.operators.ranking import top
from lodestrata.sources.checkpoints import cut


def connected_components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node on an edge (src, dst), direction ignored.

    Alternating large and small stars: each round links every node to the smallest node near it, so that the number of
    rounds grows with the logarithm of a chain's length and hub nodes shed their edges. A round is one aggregate and
    one join, in which hub nodes stay where they are; its result is checkpointed in the shared folder, and only a count
    comes to the driver.
    """
    both = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    alone = edges.select(F.col("src").alias("node")).union(edges.select("dst")).where("node IS NOT NULL").distinct()
    links = cut(both.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    before, n = None, links.count()
    for _ in range(most_rounds):
        # a node stands at most once on each link: only with more links than this can one be a hub
        meet = attach if n > HOT_ROWS else lambda df, per, key, count: df.join(per.drop(count), key)
        # large star: the larger neighbours of a node, and itself, go to its smallest neighbour
        near = links.union(links.select("b", "a"))
        least = near.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n")).select("a", F.least("a", "m").alias("m"), "_n")
        large = meet(near, least, ["a"], "_n").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n"))
        small = meet(large, low, ["a"], "_n")
        links = cut(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    root = links.groupBy("a").agg(F.min("b").alias("component"))
    return alone.join(root.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int, *, direction: str = "out") -> DataFrame:
    """(seed, node, distance): nodes within ``depth`` steps of each seed, by breadth-first rounds; the seed at 0.

    Each round joins only the newest frontier with the edges and drops what is known.
    """
    step = {"out": edges.select("src", "dst"), "in": edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))}
    step["both"] = step["out"].union(step["in"])
    links = step[direction].distinct()
    known = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("distance"))
    frontier = known
    for d in range(1, depth + 1):
        reached = frontier.select("seed", F.col("node").alias("src")).join(links, "src").select("seed", F.col("dst").alias("node")).distinct()
        frontier = cut(reached.join(known.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("distance", F.lit(d)))
        known = known.unionByName(frontier)
    return known


def view(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int, *, direction: str = "both", node_types: list[str] | None = None, edge_types: list[str] | None = None, most_nodes: int = 200) -> DataFrame:
    """(seed, nodes, edges, truncated): the size of each seed's neighbourhood under filters and a cap.

    ``nodes`` (node_id, node_type), ``edges`` (edge_id, edge_type, src, dst). Only nodes of the types wanted are entered,
    over edges of the types wanted whose ends exist. The nearest ``most_nodes`` nodes count, by distance, then id; edges
    are those met on the way: from a node closer than ``depth`` to a node of the view.
    """
    kinds = nodes if node_types is None else nodes.where(F.col("node_type").isin(node_types))
    known = kinds.select("node_id")
    e = edges if edge_types is None else edges.where(F.col("edge_type").isin(edge_types))
    enter = nodes.select("node_id").join(seeds.select(F.col("node").alias("node_id")), "node_id", "left_semi").unionByName(known).distinct()
    e = e.join(enter.withColumnRenamed("node_id", "src"), "src", "left_semi").join(enter.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    reached = cut(neighbourhood(e, seeds, depth, direction=direction))
    kept = cut(top(reached, ["seed"], ["distance", "node"], most_nodes, "place"))
    sizes = reached.groupBy("seed").agg(F.count("*").alias("all"))
    steps = {"out": [("src", "dst")], "in": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[direction]
    met = None
    for a, b in steps:
        part = kept.where(F.col("distance") < depth).select("seed", F.col("node").alias(a)).join(e.select("edge_id", a, b), a).join(kept.select("seed", F.col("node").alias(b)), ["seed", b]).select("seed", "edge_id")
        met = part if met is None else met.unionByName(part)
    edges_ = met.distinct().groupBy("seed").agg(F.count("*").alias("edges"))
    n = kept.groupBy("seed").agg(F.count("*").alias("nodes"))
    return n.join(edges_, "seed", "left").join(sizes, "seed").select("seed", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), (F.col("all") > most_nodes).alias("truncated"))


#: A frontier, or the sources still searched from, of at most this many rows go to all tasks, so that the other side stays where it is.
SMALL_FRONT = 10_000


def _search(pairs: DataFrame, links: DataFrame, most_hops: int, start: Column, grow: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """(source, target, ``name``, hops) of the pairs whose target is reached, by breadth-first rounds that all targets of a source share.

    ``start`` is the value of ``name`` at the source itself. ``grow`` makes (source, node, ``name``) out of a frontier
    joined with ``links`` (src, dst); a round keeps of it the nodes that their source reaches for the first time. So a
    round carries what each source reaches, once and not once for each target. A source without open targets is left
    out, and the search ends when there is none.
    """
    wanted = cut(pairs.select("source", "target").distinct())
    open_ = wanted.where("source <> target")
    found = wanted.where("source = target").select("source", "target", start.alias(name), F.lit(0).alias("hops"))
    front = open_.select("source").distinct().select("source", F.col("source").alias("node"), start.alias(name))
    seen = front.select("source", "node")
    few = lambda df, n: F.broadcast(df) if n <= SMALL_FRONT else df
    for h in range(1, most_hops + 1):
        n = front.count()
        if not n:
            break
        grown = grow(few(front, n).join(links, F.col("node") == F.col("src")))
        marks = wanted.select("source", F.col("target").alias("node"), F.lit(True).alias("hit"))
        # in the last round only targets count
        front = cut(grown.join(seen, ["source", "node"], "left_anti").join(marks, ["source", "node"], "left" if h < most_hops else "inner"))
        hits = front.where("hit").select("source", F.col("node").alias("target"), name)
        found = found.unionByName(hits.withColumn("hops", F.lit(h)))
        open_ = open_.join(hits, ["source", "target"], "left_anti")
        sources = open_.select("source").distinct()
        seen = seen.unionByName(front.select("source", "node"))
        front = front.drop("hit").join(few(sources, sources.count()), "source", "left_semi")
    return found


def list_paths(edges: DataFrame, pairs: DataFrame, most_hops: int, most_paths: int) -> DataFrame:
    """(source, target, path, hops): up to ``most_paths`` of the shortest directed paths of each pair, as edge ids; parallel edges give paths of their own.

    Each round keeps the first ``most_paths`` ways, by edge ids, to each node that a source reaches for the first time: more
    could not be listed. A pair of equal ends has one path without edges.
    """
    def grow(met: DataFrame) -> DataFrame:
        ways = met.select("source", F.col("dst").alias("node"), F.concat("path", F.array("edge_id")).alias("path"))
        return top(ways, ["source", "node"], ["path"], most_paths, "_k").drop("_k")

    return _search(pairs, edges.select("edge_id", "src", "dst"), most_hops, F.array().cast("array<string>"), grow, "path")


def shortest_paths(edges: DataFrame, pairs: DataFrame, most_hops: int) -> DataFrame:
    """(source, target, hops, paths): the length of the shortest directed path of each pair and how many there are, parallel edges apart.

    Paths are counted, not listed: each round carries one row for a source and a node reached, however many ways lead there.
    """
    grow = lambda met: met.groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
    return _search(pairs, edges.select("src", "dst"), most_hops, F.lit(1).cast("long"), grow, "paths").select("source", "target", "hops", "paths")
