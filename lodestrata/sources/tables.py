"""Reading the parquet tables a query runs on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Partitions that a small table is spread over at most.
MOST_SPREAD = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``; columns are pruned by whatever the caller selects."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


def spread(df: DataFrame) -> DataFrame:
    """A table of a few small files over more partitions, for work that costs far more than the rows' transfer.

    Only tables of fewer than ``MOST_SPREAD`` partitions are moved, which hold ``spark.sql.files.maxPartitionBytes``
    (128 MB) each at most, 2 GB in all; larger ones stay as they are stored, on however many cores.
    """
    wanted = min(MOST_SPREAD, df.sparkSession.sparkContext.defaultParallelism)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
