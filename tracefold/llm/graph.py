"""Connected components by alternating star contraction, without collecting edges or labels."""

from __future__ import annotations

import gc

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.shared import bounded_batches as bounded_batches, checkpointed

#: Places over which the rows of one key are dealt.
SALTS = 64


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffles that nothing refers to any more: it learns of them as the driver's JVM collects."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the same components: each node that isn't the smallest of its component, and the smallest."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, other = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[one], root[other])
        before = root.copy()
        for side in (one, other):
            np.minimum.at(root, before[side], low)
            np.minimum.at(root, side, low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
        if (root == before).all():
            far = np.flatnonzero(root != np.arange(len(nodes)))
            return nodes[far], nodes[root[far]]


def with_least(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows with the least `value` of their key as `name`, nulls left out; the key and salt columns may not be null.

    Rows of one key are dealt over SALTS places: each place has its minimum, the minima of a key meet, and
    what they give goes back to the places. So no task gathers the rows of a hot key.
    """
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).repartition(key, "salt")
    part = dealt.groupBy(key, "salt").agg(F.min(value).alias("part"))
    told = part.select(key, "salt", F.min("part").over(Window.partitionBy(key)).alias(name))
    return dealt.join(told, [key, "salt"]).select(*rows.columns, name)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an undirected edge table (a, b): root is the smallest node reachable.

    Every round replaces edges by stars around smaller nodes; the neighbours of a hot node are spread by
    `with_least`. Loops are ignored; nulls are not nodes. It ends when every node that has a smaller
    neighbour has that one alone, which has none, after O(log n) rounds in practice.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars_only(now):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, "a", "b", "m").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct()
        near = with_least(large, "a", "b", "m").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        now = checkpointed(near.where("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars_only(edges: DataFrame) -> bool:
    """Whether each `a` has one edge, and no `b` is an `a`."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionAll(edges.select(F.col("b").alias("n"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    return ends.groupBy("n").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low > 1 OR low = 1 AND high = 1").isEmpty()
