"""Extensions that Spark supplies: social graph queries, windows in event time, as-of join, roll-ups, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def follow_counts(relation: DataFrame) -> DataFrame:
    """Per user: whom they follow and who follows them, over the edges (user_id, to_user_id)."""
    out = relation.select(F.col("user_id").alias("id"), F.lit(1).alias("follow"), F.lit(0).alias("follower"))
    into = relation.select(F.col("to_user_id").alias("id"), F.lit(0).alias("follow"), F.lit(1).alias("follower"))
    return out.union(into).groupBy("id").agg(F.sum("follow").alias("follow_count"), F.sum("follower").alias("follower_count"))


def mutual(relation: DataFrame) -> DataFrame:
    """Pairs that follow each other, the lower id first."""
    pair = relation.where("user_id <> to_user_id").select(
        F.least("user_id", "to_user_id").alias("a"), F.greatest("user_id", "to_user_id").alias("b"), (F.col("user_id") < F.col("to_user_id")).alias("up")
    )
    return pair.groupBy("a", "b").agg(F.countDistinct("up").alias("n")).where("n = 2").select("a", "b")


def tumbling(events: DataFrame, width: str, *keys: str) -> DataFrame:
    """Count and sum of ``value`` in tumbling windows of ``ts``."""
    w = F.window("ts", width)
    return events.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(*keys, F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str, key: str) -> DataFrame:
    """Sessions of each key: runs of events no further apart than ``gap``."""
    w = F.session_window("ts", gap)
    return events.groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each left row with the right ``value`` last known at its time: one union, one shuffle, no range join."""
    a = left.withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__left", F.lit(1))
    b = right.select(key, at, F.col(value).alias("__v")).withColumn("__left", F.lit(0))
    order = Window.partitionBy(key).orderBy(at, "__left").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(order)).where("__left = 1").drop("__v", "__left")


def roll_up(rows: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Totals by every prefix of the keys; ``level`` tells how many keys are summed over."""
    return rows.rollup(*keys).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum(measure).alias("total"))
