"""States of a graph in a store: each a partition of parquet files with a digest, replaced, read back and dropped as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.graph import changes, content_digest

NODE_COLUMNS, EDGE_COLUMNS = ["node_id", "node_type", "label"], ["edge_id", "edge_type", "src", "dst"]


class Snapshots:
    """A store below one folder that all executors share: ``nodes`` and ``edges`` by snapshot, ``manifest`` with rows and digests.

    A snapshot counts from when its manifest is written, last of all: a job that dies before leaves none. Writing a
    snapshot again overwrites it.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, what: str, snapshot: str) -> str:
        if not snapshot or any(c in snapshot for c in "/=\\"):
            raise ValueError(f"not a name of a snapshot: {snapshot!r}")
        return f"{self.root}/{what}/snapshot_id={snapshot}"

    @staticmethod
    def _digests(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        n = content_digest(nodes, NODE_COLUMNS).select(F.lit("nodes").alias("element"), "rows", "digest")
        return n.unionByName(content_digest(edges, EDGE_COLUMNS).select(F.lit("edges").alias("element"), "rows", "digest"))

    def replace(self, snapshot: str, nodes: DataFrame, edges: DataFrame) -> None:
        nodes, edges = nodes.select(*NODE_COLUMNS), edges.select(*EDGE_COLUMNS)
        nodes.write.mode("overwrite").parquet(self._path("nodes", snapshot))
        edges.write.mode("overwrite").parquet(self._path("edges", snapshot))
        written = self._read("nodes", snapshot), self._read("edges", snapshot)
        self._digests(*written).withColumn("live", F.lit(True)).coalesce(1).write.mode("overwrite").parquet(self._path("manifest", snapshot))

    def _read(self, what: str, snapshot: str) -> DataFrame:
        return self.spark.read.parquet(self._path(what, snapshot))

    def load(self, snapshot: str) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges, whose digests must be those of the manifest; a dropped snapshot is refused."""
        kept = {r.element: (r.rows, r.digest) for r in self._read("manifest", snapshot).where("live").collect()}  # two rows
        nodes, edges = self._read("nodes", snapshot), self._read("edges", snapshot)
        if {r.element: (r.rows, r.digest) for r in self._digests(nodes, edges).collect()} != kept:
            raise ValueError(f"snapshot {snapshot} is not as it was written")
        return nodes, edges

    def upsert(self, snapshot: str, nodes: DataFrame, edges: DataFrame, target: str) -> DataFrame:
        """``target`` becomes ``snapshot`` with the given rows added or put in place of those of the same id; (element, kind, created, reused, removed)."""
        old_nodes, old_edges = self.load(snapshot)
        new_nodes = nodes.select(*NODE_COLUMNS).unionByName(old_nodes.join(nodes.select("node_id"), "node_id", "left_anti").select(*NODE_COLUMNS))
        new_edges = edges.select(*EDGE_COLUMNS).unionByName(old_edges.join(edges.select("edge_id"), "edge_id", "left_anti").select(*EDGE_COLUMNS))
        self.replace(target, new_nodes, new_edges)
        n, e = self.load(target)
        a = changes(old_nodes, n, "node_id", "node_type").select(F.lit("node").alias("element"), F.col("node_type").alias("kind"), "created", "reused", "removed")
        return a.unionByName(changes(old_edges, e, "edge_id", "edge_type").select(F.lit("edge").alias("element"), F.col("edge_type").alias("kind"), "created", "reused", "removed"))

    def drop(self, snapshot: str) -> None:
        """Marks a snapshot as dropped; its files may be cleared afterwards."""
        rows = [(r.element, r.rows, r.digest, False) for r in self._read("manifest", snapshot).collect()]
        self.spark.createDataFrame(rows, "element string, rows long, digest string, live boolean").coalesce(1).write.mode("overwrite").parquet(self._path("manifest", snapshot))
