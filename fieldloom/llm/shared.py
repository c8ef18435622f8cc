"""Lineage cuts that survive the loss of an executor, and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.checkpoint import checkpoint_dir, cut

__all__ = ["checkpoint_dir", "connected_components", "cut", "delete", "fresh", "scratch", "setting"]


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder from whatever file system it is in; it may be gone already."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for what runs within."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables checkpointed within are removed at the end: what was made from them must be written by then."""
    before = checkpoint_dir(spark)
    inner = f"{before}/scratch-{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(inner)
    try:
        yield
    finally:
        delete(spark, inner)
        # setCheckpointDir would go to a new folder below.
        getattr(spark.sparkContext._jsc.sc(), "checkpointDir_$eq")(spark._jvm.scala.Some(before))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have (case doesn't count)."""
    taken = {c.lower() for c in df.columns}
    out, k = f"__{name}", 0
    while out.lower() in taken:
        out, k = f"__{name}_{k}", k + 1
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of undirected ``edges(u, v)``; root is the component's least node.

    Alternates large-star and small-star steps until the edge set stays the same. The least
    neighbour of a node is an aggregate, combined before its shuffle, and comes back by a join
    whose hot side may be split: no task holds all neighbours of a node, however many it has.
    Self loops and null ends are dropped; nodes without another node don't appear.
    """
    e = cut(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("root"))
            ).distinct()
        seen = now
