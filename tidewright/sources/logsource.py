"""A Python data source over a sequenced log of Parquet files that prunes by sequence, and a definition loader."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual

#: Schemas of quotes, trades, ticks and workflow definitions, as DDL.
QUOTE = (
    "header struct<msg_type:string,msg_len:bigint,sequence:bigint,timestamp:bigint>, symbol string, bid_price double, ask_price double, "
    "bid_volume bigint, ask_volume bigint, timestamp bigint"
)
TRADE = "symbol string, price double, volume bigint, update_time bigint, type int, channel_id int"
TICK = "skey int, timestamp bigint, bidPrice double, bidSize bigint, askPrice double, askSize bigint, side string"
DEFINITION = (
    "name string, tasks array<struct<name:string,command:string,result_check:string,depends_on:array<string>>>, "
    "triggers array<struct<cron:string,webhook:string>>"
)


class Slice(InputPartition):
    """An inclusive range of sequences."""

    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class TickGenerator(DataSource):
    """``spark.read.format("tidewright_ticks")``: deterministic ticks (seq, skey, timestamp, price, side) by rule.

    Options ``rows``, ``keys`` and ``slices``. Filters on ``seq`` cut the slices that are made at all.
    """

    @classmethod
    def name(cls) -> str:
        return "tidewright_ticks"

    def schema(self) -> str:
        return "seq bigint, skey int, timestamp bigint, price double, side string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _TickReader(self.options)


class _TickReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.keys, self.slices = int(options.get("keys", 10)), int(options.get("slices", 4))
        self.start, self.end = 1, int(options.get("rows", 10_000))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("seq",):
                self.start = max(self.start, f.value)
            elif isinstance(f, LessThanOrEqual) and f.attribute == ("seq",):
                self.end = min(self.end, f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("seq",):
                self.start, self.end = max(self.start, f.value), min(self.end, f.value)
            else:
                yield f

    def partitions(self) -> list[Slice]:
        n = max(0, self.end - self.start + 1)
        step = -(-n // self.slices) or 1
        return [Slice(s, min(self.end, s + step - 1)) for s in range(self.start, self.end + 1, step)] or [Slice(1, 0)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        for seq in range(partition.start, partition.end + 1):
            key = 1001 + (seq - 1) % self.keys
            yield seq, key, (seq - 1) // self.keys * 1000, 1000.0 + (seq * 7919 + key) % 1000, "B" if seq % 2 else "S"


def definitions(spark: SparkSession, documents: list[str]) -> DataFrame:
    """Workflow definitions from JSON texts, or YAML ones where a YAML reader is installed."""
    rows = []
    for text in documents:
        if text.lstrip().startswith("{"):
            raw = json.loads(text)
        else:
            import yaml

            raw = yaml.safe_load(text)
        tasks = [{k: t.get(k) for k in ("name", "command", "result_check")} | {"depends_on": t.get("depends_on") or []} for t in raw.get("tasks") or []]
        rows.append((raw.get("name"), tasks, [{k: t.get(k) for k in ("cron", "webhook")} for t in raw.get("triggers") or []]))
    return spark.createDataFrame(rows, DEFINITION)
