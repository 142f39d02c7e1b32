"""Structured Streaming forms of the log operators: audit, de-duplication, time-out, latest status, publishing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

AUDIT = "channel string, arrival long, seq long, expected long, verdict string, nack_start long, nack_end long"


def _audit(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen = state.get[0] if state.exists else 0
    rows = pd.concat(list(frames)).sort_values(["arrival", "seq"], kind="stable")
    top = rows["seq"].cummax()
    expected = top.shift(fill_value=0).clip(lower=seen) + 1
    gap = rows["seq"] > expected
    out = pd.DataFrame({"channel": key[0], "arrival": rows["arrival"], "seq": rows["seq"], "expected": expected})
    out["verdict"] = ["gap" if g else "in_order" if s == e else "stale" for g, s, e in zip(gap, rows["seq"], expected, strict=True)]
    out["nack_start"] = expected.where(gap).astype("Int64")
    out["nack_end"] = (rows["seq"] - 1).where(gap).astype("Int64")
    state.update((max(seen, int(top.iloc[-1])),))
    yield out


def sequence_audit(arrivals: DataFrame) -> DataFrame:
    """The sequence audit of a stream: each channel's largest sequence is its state.

    Equal to the batch audit where batches come in order of arrival.
    """
    return arrivals.groupBy("channel").applyInPandasWithState(_audit, AUDIT, "seen long", "append", GroupStateTimeout.NoTimeout)


def distinct_messages(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Each (channel, seq) once, within the watermark on ``ts``."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["channel", "seq"])


def silent_spells(heartbeats: DataFrame, limit: str = "30 seconds", watermark: str = "1 minute") -> DataFrame:
    """Active spells of each subscriber, closed by a silence of ``limit``."""
    spell = F.session_window("ts", limit)
    return (
        heartbeats.withWatermark("ts", watermark).groupBy("subscriber", spell.alias("w"))
        .agg(F.count("*").alias("beats")).select("subscriber", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "beats")
    )


def windowed(events: DataFrame, width: str, watermark: str) -> DataFrame:
    """Counts in tumbling windows of event time; late rows beyond the watermark are left out."""
    w = F.window("ts", width)
    return events.withWatermark("ts", watermark).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def parse_status(stream: DataFrame) -> DataFrame:
    """Status events from JSON text in ``value``."""
    schema = "execution_id string, task_name string, status string, event_seq long, stdout string, stderr string"
    return stream.select(F.from_json("value", schema).alias("e")).select("e.*").where("execution_id IS NOT NULL")


def publish(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None):
    """Append a stream to a log of Parquet files as far as it is there; ``each`` sees every batch once it is written."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if each is not None:
            each(batch, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_status(stream: DataFrame, path: str, checkpoint: str):
    """Keep the last status of each (execution_id, task_name) in a Parquet table, rewritten from version to version.

    Each batch is merged with version n and written as version n + 1; batches that come again write the same version.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.select("execution_id", "task_name", "status", "event_seq")
        if number > 0:
            new = new.union(spark.read.parquet(f"{path}/version={number - 1}").select(*new.columns))
        last = new.groupBy("execution_id", "task_name").agg(F.max_by("status", "event_seq").alias("status"), F.max("event_seq").alias("event_seq"))
        last.write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
