"""Reliable checkpoints in the shared folder, and connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the session names in ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary one; on a cluster executors would not share it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidewright-"))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def spanning_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least of the ``n`` places that each place reaches over the links (i, j)."""
    label = np.arange(n)
    while True:
        near = label.copy()
        np.minimum.at(near, i, label[j])
        np.minimum.at(near, j, label[i])
        near = near[near]
        if (near == label).all():
            return label
        label = near


#: Edges, after doubles are dropped, up to which one task finds the components: some megabytes of memory.
ONE_TASK_EDGES = 200_000


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges (u, v) by union-find, the least node at the root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "component"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b); a component is its least node.

    Up to ``ONE_TASK_EDGES`` edges, which are counted first, one task joins them. Beyond, large-star and small-star
    rounds alternate until the edges are stars: a number of rounds that grows with the logarithm of the nodes, each of
    two joins on a pre-aggregated minimum.
    """
    edges = checkpoint(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct())
    if edges.count() <= ONE_TASK_EDGES:
        return checkpoint(edges.repartition(1).mapInArrow(_union, "node long, component long"))
    seen = None
    while True:
        both = edges.select("u", "v").union(edges.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").selectExpr("v AS u", "least(m, u) AS v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").selectExpr("v AS u", "m AS v")
        edges = checkpoint(small.union(least.selectExpr("u", "m AS v")).where("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return edges.selectExpr("u AS node", "v AS component").union(
        edges.selectExpr("v AS node", "v AS component").distinct()
    )


def row_mark(*columns: str) -> Column:
    """A hash of columns, each with its place and whether it is null: rows equal in all of them have one mark."""
    parts = [x for i, c in enumerate(columns) for x in (F.lit(i), F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return F.xxhash64(*parts)


#: Keys of many rows that are sent to all tasks, at most.
HOT_KEYS = 50_000
#: Rows from which a key may be hot.
HOT_ROWS = 1000


def attach(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with the facts (``key``, ``copies`` and more), one for each key of ``total`` rows in all.

    A key may hold a large share of the rows. Those of more than ``HOT_ROWS`` rows, and of more than one row in
    ``HOT_KEYS``, are at most ``HOT_KEYS``: their facts go to all tasks and their rows stay where they are. Rows of other
    keys, each a small part of the whole, are joined by a shuffle.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(facts.where(F.col("copies") > limit))
    spread = rows.join(hot, key)
    rest = rows.join(hot.select(key), key, "left_anti").join(facts.where(F.col("copies") <= limit), key)
    return spread.unionByName(rest)
