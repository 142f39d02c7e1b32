"""Subscriber sessions: time-outs, and grouping by progress, subnet or priority."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distance from a group's first member, and members, that a progress group may have.
THRESHOLD, CAPACITY = 100, 50


def heartbeat_timeout(heartbeats: DataFrame, now: Column, limit: str = "INTERVAL 30 SECONDS") -> DataFrame:
    """(subscriber, last_seen, active): active unless silent for longer than ``limit`` before ``now``."""
    seen = heartbeats.groupBy("subscriber").agg(F.max("at").alias("last_seen"))
    return seen.withColumn("active", F.col("last_seen") >= now - F.expr(limit))


def progress_groups(sessions: DataFrame, threshold: int = THRESHOLD, capacity: int = CAPACITY) -> DataFrame:
    """Greedy clusters of a channel's sessions (channel, subscriber, next_send) by progress.

    Sessions go by ``next_send``, then name; one starts a new group when it lies more than ``threshold`` beyond the
    group's first member or the group is full. The rule depends on where the last group began, so a channel's sessions
    are run through in order, with nothing held but the group's first member and size.
    """
    rows = sessions.select("channel", "subscriber", F.col("next_send").cast("long").alias("next_send"))
    kinds = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, anchor, size, group = None, None, 0, -1
        for batch in batches:
            names = []
            for c, at in zip(batch["channel"].to_pylist(), batch["next_send"].to_pylist(), strict=True):
                if anchor is None or c != channel:
                    channel, anchor, size, group = c, at, 1, 0
                elif at - anchor > threshold or size >= capacity:
                    anchor, size, group = at, 1, group + 1
                else:
                    size += 1
                names.append(f"progress_{group}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], [*batch.schema.names, "group_id"])

    ordered = rows.repartition("channel").sortWithinPartitions("channel", "next_send", "subscriber")
    return ordered.mapInArrow(run, T.StructType([*kinds.fields, T.StructField("group_id", T.StringType())]))


def group_bounds(grouped: DataFrame) -> DataFrame:
    """Least and greatest next sequence, members, and whether all are active, of each (channel, group_id)."""
    return grouped.groupBy("channel", "group_id").agg(
        F.min("next_send").alias("min_seq"), F.max("next_send").alias("max_seq"), F.count("*").alias("members"),
        F.bool_and("active").alias("all_active"),
    )


def regroup_needed(bounds: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Whether a group has spread beyond twice the threshold."""
    return bounds.withColumn("regroup", F.col("max_seq") - F.col("min_seq") > 2 * threshold)


def group_send(bounds: DataFrame, batch: int = 10) -> DataFrame:
    """The range each group is sent next, from its slowest member; none while a member is inactive."""
    return bounds.where("all_active").select(
        "channel", "group_id", F.col("min_seq").alias("from_seq"), F.least("max_seq", F.col("min_seq") + batch - 1).alias("to_seq"), "members"
    )


def subnet(ip: Column) -> Column:
    """The first three octets of a dotted address."""
    return F.substring_index(ip, ".", 3)


def subnet_groups(sessions: DataFrame) -> DataFrame:
    """Subnets of two or more sessions, with a multicast address that is derived from the subnet."""
    groups = sessions.groupBy("channel", subnet(F.col("ip")).alias("subnet")).agg(
        F.count("*").alias("members"), F.array_join(F.sort_array(F.collect_set("subscriber")), ",").alias("subscribers")
    )
    octet = lambda i: F.split("subnet", r"\.")[i].cast("int")
    address = F.concat_ws(".", F.lit("239"), *[octet(i).bitwiseAND(255).cast("string") for i in range(3)])
    return groups.where("members >= 2").withColumn("multicast", address)


def priority_groups(sessions: DataFrame) -> DataFrame:
    """Each session of priority 2 alone, those of priority 1 together, the others in no group."""
    name = F.when(F.col("priority") == 2, F.concat(F.lit("vip_"), "subscriber")).when(F.col("priority") == 1, "high_priority")
    return sessions.select("channel", "subscriber", "priority", name.alias("group_id"))


def ungrouped(sessions: DataFrame, grouped: DataFrame) -> DataFrame:
    """Sessions that are in no group."""
    return sessions.join(grouped.where("group_id IS NOT NULL"), ["channel", "subscriber"], "left_anti")


def session_of_packet(packets: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each packet's subscriber by address and port; of several the first by name."""
    first = sessions.groupBy("ip", "port").agg(F.min("subscriber").alias("subscriber"))
    return packets.join(first, ["ip", "port"], "left")


def fan_out(sends: DataFrame, grouped: DataFrame, multicast: bool) -> DataFrame:
    """What is sent for each group's range (channel, group_id, from_seq, to_seq): one datagram to the group, or one to
    each of its members (channel, group_id, subscriber)."""
    if multicast:
        return sends.select("channel", "group_id", F.col("group_id").alias("receiver"), "from_seq", "to_seq")
    members = grouped.select("channel", "group_id", F.col("subscriber").alias("receiver"))
    return members.join(sends, ["channel", "group_id"]).select("channel", "group_id", "receiver", "from_seq", "to_seq")


def regroup(sessions: DataFrame, threshold: int = THRESHOLD, capacity: int = CAPACITY) -> DataFrame:
    """(channel, subscriber, group_id): groups by priority first, of the rest by progress, of those alone there by subnet.

    A session that none of the three puts with another is in no group.
    """
    first = priority_groups(sessions).where("group_id IS NOT NULL").select("channel", "subscriber", "group_id")
    rest = ungrouped(sessions, first)
    near = progress_groups(rest, threshold, capacity)
    several = near.groupBy("channel", "group_id").count().where("count > 1").select("channel", "group_id")
    second = near.join(several, ["channel", "group_id"]).select("channel", "subscriber", "group_id")
    alone = ungrouped(rest, second).withColumn("net", subnet(F.col("ip")))
    nets = alone.groupBy("channel", "net").count().where("count > 1").select("channel", "net", F.concat(F.lit("subnet_"), "net").alias("group_id"))
    return first.union(second).union(alone.join(nets, ["channel", "net"], "left").select("channel", "subscriber", "group_id"))


def regroup_due(channels: DataFrame, threshold: int = THRESHOLD, nacks: int = 5, every_s: int = 10) -> DataFrame:
    """Why each channel (channel, joined, left, timed_out, nack_count, since_s, span) is to be grouped anew, first reason
    first: members came or went, one timed out, one asked for more than ``nacks`` repairs, ``every_s`` seconds went by, or a
    group spread beyond twice the threshold. Null where none holds."""
    reason = (
        F.when((F.col("joined") > 0) | (F.col("left") > 0), "membership").when(F.col("timed_out") > 0, "time_out")
        .when(F.col("nack_count") > nacks, "repairs").when(F.col("since_s") >= every_s, "interval").when(F.col("span") > 2 * threshold, "spread")
    )
    return channels.select("channel", reason.alias("reason"), reason.isNotNull().alias("due"))


def login(subscribers: DataFrame, tries: int = 10, pause_ms: int = 100) -> DataFrame:
    """How each subscriber (subscriber, last_recv, answers_ms) gets in: it asks for an answer ``tries`` times, ``pause_ms``
    apart, and the publisher answers from ``answers_ms`` on; null never.

    (subscriber, tries, connected, expected_seq): the tries made, and the sequence that is expected once connected.
    """
    asked = F.ceil(F.col("answers_ms") / pause_ms)
    needed = F.when(asked > 0, asked + 1).when(asked.isNotNull(), F.lit(1).cast("long"))
    connected = F.coalesce(needed <= tries, F.lit(False))
    return subscribers.select(
        "subscriber", F.when(connected, needed).otherwise(F.lit(tries).cast("long")).alias("tries"), connected.alias("connected"),
        F.when(connected, F.coalesce("last_recv", F.lit(0).cast("long")) + 1).alias("expected_seq"),
    )


def directory(beats: DataFrame, now: Column, limit: str) -> DataFrame:
    """The servers (server, address, last_seen) that a directory lists at ``now``: those whose last beat (server, address,
    at) is not older than ``limit``, at the address of that beat; of several at one time the greatest."""
    last = beats.groupBy("server").agg(F.max(F.struct("at", "address")).alias("b"))
    return last.select("server", F.col("b.address").alias("address"), F.col("b.at").alias("last_seen")).where(F.col("last_seen") >= now - F.expr(limit))


def download(clients: DataFrame, window: int = 8, limit_ms: int = 1000) -> DataFrame:
    """The blocks each client (client, acked, sent, blocks, silent_ms) is sent next, from 1 to ``blocks``.

    Up to ``window`` blocks lie between the last acknowledged and the last sent one. At the end of the window the sender
    waits; once that took longer than ``limit_ms`` it starts again after the last acknowledged block.
    """
    end = F.least(F.col("blocks"), F.col("acked") + window)
    waits = F.col("sent") >= end
    rewound = waits & (F.col("acked") < F.col("blocks")) & (F.col("silent_ms") > limit_ms)
    first = F.when(rewound, F.col("acked") + 1).when(~waits, F.col("sent") + 1)
    return clients.select(
        "client", rewound.alias("rewound"), first.alias("from_block"), F.when(first.isNotNull(), end).alias("to_block"),
        (F.col("acked") >= F.col("blocks")).alias("done"),
    )
