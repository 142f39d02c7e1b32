"""Ordered reading of many per-key streams: selection, merge in time order, and checks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

#: Root of the stored streams' paths (fixed value).
ROOT = "mdl/mbd/order/"


def merged(ticks: DataFrame, keys: list[int] | None = None, date: str | None = None) -> DataFrame:
    """The chosen streams' rows in one order of (ts, skey, seq); no keys, no rows.

    A range exchange and a sort within its partitions: any number of streams merges without a single task seeing all.
    """
    chosen = ticks if keys is None else ticks.where(F.col("skey").isin(keys))
    if date is not None:
        chosen = chosen.where(F.to_date("ts") == F.lit(date).cast("date"))
    return chosen.orderBy("ts", "skey", "seq")


def positions(ticks: DataFrame) -> DataFrame:
    """Each row's place within its own stream, from 1."""
    return ticks.withColumn("pos", F.row_number().over(Window.partitionBy("skey").orderBy("ts", "seq")))


def violations(ticks: DataFrame, *order: str) -> DataFrame:
    """Rows and steps back in time of each stream, its rows being taken in the given order."""
    before = F.lag("ts").over(Window.partitionBy("skey").orderBy(*order))
    back = ticks.withColumn("back", F.coalesce(F.col("ts") < before, F.lit(False)))
    return back.groupBy("skey").agg(F.count("*").alias("n"), F.count_if("back").alias("violations"))


def counts(ticks: DataFrame) -> DataFrame:
    """Rows of each stream."""
    return ticks.groupBy("skey").agg(F.count("*").alias("n"))


def object_key(date: Column, skey: Column) -> Column:
    """The path under which one day of one stream is stored."""
    return F.concat(F.lit(ROOT), F.date_format(date, "yyyyMMdd"), F.lit("/"), skey.cast("string"), F.lit(".parquet"))


def key_of_path(path: Column) -> Column:
    """The stream id between the last slash and the suffix."""
    return F.regexp_extract(path, r"([^/]+)\.parquet$", 1).cast("long")


def listing(ticks: DataFrame, prefix: str = "") -> DataFrame:
    """The distinct object keys under a prefix."""
    keys = ticks.select(object_key(F.col("ts"), F.col("skey")).alias("key")).distinct()
    return keys.where(F.col("key").startswith(prefix))


def discovery(ticks: DataFrame) -> DataFrame:
    """Per day: how many streams there are, by their object keys, and their ids' least and greatest."""
    keys = listing(ticks).select(F.substring("key", len(ROOT) + 1, 8).alias("day"), key_of_path(F.col("key")).alias("skey"))
    return keys.groupBy("day").agg(F.count("*").alias("streams"), F.min("skey").alias("first_key"), F.max("skey").alias("last_key"))


def first_rows(ticks: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of the merged streams: each task keeps its own first ``n``, so nothing is sorted whole."""
    return ticks.orderBy("ts", "skey", "seq").limit(n)


class OrderReader:
    """One-by-one reading of merged streams, with reset. The merge runs in Spark; rows come partition by partition."""

    def __init__(self, ticks: DataFrame, keys: list[int], date: str | None = None) -> None:
        self.rows = merged(ticks, keys, date)
        self.reset()

    def reset(self) -> None:
        """Start again at the first row."""
        self._iterator: Iterator[Row] | None = None

    def next_order(self) -> Row | None:
        """The next row, or None after the last."""
        if self._iterator is None:
            self._iterator = self.rows.toLocalIterator()
        return next(self._iterator, None)
