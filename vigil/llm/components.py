"""Connected components of links, all on Spark: alternating large-star and
small-star steps.  Nodes are longs; only counts reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import remove, shared_path


def _put(df: DataFrame, schema: str) -> tuple[DataFrame, str]:
    """Rows written once and read back; the caller removes the folder."""
    spark = df.sparkSession
    path = shared_path(spark, "links")
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), path


def _stars(edges: DataFrame) -> tuple[DataFrame, str]:
    """One large-star and one small-star step over edges (a > b).

    The least neighbours are written before they are joined, so that both
    sides of a join are plain shuffles, which Spark can split where one node
    (the hub of a star) has a large part of all edges."""
    spark = edges.sparkSession
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low, low_path = _put(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "a long, m long")
    large, large_path = _put(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                             .filter("a > b").distinct(), "a long, b long")
    # here a node's edges lead to smaller ones only: few, unless it is large for all
    low2, low2_path = _put(large.groupBy("a").agg(F.min("b").alias("m")), "a long, m long")
    out, path = _put(large.join(low2, "a").select(
        F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        .filter("a > b").distinct(), "a long, b long")
    for done in (low_path, large_path, low2_path):
        remove(spark, done)
    return out, path


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest
    node that can be reached.  Nodes without a link aren't returned."""
    spark = links.sparkSession

    def mark(edges: DataFrame) -> tuple:
        # the steps end when no edge changes; a sum of hashes tells
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    first = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    edges, path = _put(first, "a long, b long")
    now = mark(edges)
    while now[0]:
        new, new_path = _stars(edges)
        new_mark = mark(new)
        remove(spark, path)
        same = new_mark == now
        edges, path, now = new, new_path, new_mark
        if same:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) \
        .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
