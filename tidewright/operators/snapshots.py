"""Snapshot deltas, fragments, un-acknowledged commands and send pacing (described behaviours, as queries)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAGMENT = 1300
RING, MARGIN = 32, 3
RELIABLE_RING = 64


def field_delta(states: DataFrame, fields: list[str]) -> DataFrame:
    """Each state of an entity (entity, seq, fields) against the one before: change mask (bit i for field i), number of
    the last changed field from 1 (0: none), and whether the state is sent in full, having none before."""
    order = Window.partitionBy("entity").orderBy("seq")
    first = F.row_number().over(order) == 1
    changed = [first | ~F.col(f).eqNullSafe(F.lag(f).over(order)) for f in fields]
    mask = reduce(lambda a, b: a + b, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(changed)])
    last = F.greatest(*[F.when(c, i + 1).otherwise(0) for i, c in enumerate(changed)], F.lit(0))
    return states.select("entity", "seq", first.alias("full"), mask.alias("mask"), last.alias("last_changed"))


def field_frequencies(deltas: DataFrame, fields: list[str]) -> DataFrame:
    """How often each field changed, to order fields by."""
    counts = deltas.agg(*[F.count_if(F.col("mask").bitwiseAND(1 << i) != 0).alias(f) for i, f in enumerate(fields)])
    return counts.unpivot([], fields, "field", "changes")


def match_snapshots(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Entities of two snapshots: added, removed, changed or same."""
    a = old.select(F.col(key), F.struct(*fields).alias("a"))
    b = new.select(F.col(key), F.struct(*fields).alias("b"))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, kind.alias("change"))


def delta_base(sends: DataFrame, ring: int = RING, margin: int = MARGIN) -> DataFrame:
    """Whether a snapshot (client, seq, acked) goes as a delta to the acknowledged one or in full: the base must lie
    less than ``ring - margin`` back."""
    distance = F.col("seq") - F.col("acked")
    delta = F.col("acked").isNotNull() & (F.col("acked") > 0) & (distance < ring - margin)
    return sends.select("client", "seq", "acked", F.when(delta, "delta").otherwise("full").alias("kind"))


def fragments(messages: DataFrame, size: int = FRAGMENT) -> DataFrame:
    """(id, piece, length) of each message (id, length): under ``size`` bytes one piece, else pieces of ``size`` and a
    last shorter one, which is empty after an exact multiple."""
    pieces = F.floor(F.col("length") / size).cast("int")
    each = messages.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces)))
    return each.select("id", "piece", F.least(F.lit(size), F.col("length") - F.col("piece") * size).alias("length"))


def reassemble(pieces: DataFrame, size: int = FRAGMENT) -> DataFrame:
    """Messages whose pieces are all there up to a last short one: (id, length)."""
    held = pieces.dropDuplicates(["id", "piece"]).groupBy("id").agg(
        F.count("*").alias("n"), F.max("piece").alias("last"), F.sum("length").alias("length"), F.max_by("length", "piece").alias("tail")
    )
    return held.where((F.col("n") == F.col("last") + 1) & (F.col("tail") < size)).select("id", "length")


def unacknowledged(clients: DataFrame, commands: DataFrame, ring: int = RELIABLE_RING) -> DataFrame:
    """Per client (client, ack): commands sent again on each packet, and whether the ring has overflown."""
    open_ = commands.join(clients, "client").where(F.col("seq") > F.col("ack"))
    counts = open_.groupBy("client").agg(F.count("*").alias("n_open"), F.min("seq").alias("first_open"), F.max("seq").alias("last_open"))
    return counts.withColumn("dropped", F.col("n_open") >= ring)


def redundant(commands: DataFrame, copies: int = 2) -> DataFrame:
    """Packets that repeat each command (client, seq) ``copies`` times more, and the commands that are new in each."""
    packets = commands.withColumn("packet", F.explode(F.sequence(F.col("seq"), F.col("seq") + copies)))
    first = packets.groupBy("client", "seq").agg(F.min("packet").alias("packet"), F.count("*").alias("times"))
    return first


def choke(sends: DataFrame, max_packets: int) -> DataFrame:
    """Commands (client, at_ms) gathered in slots of ``1000 / max_packets`` milliseconds."""
    slot = F.floor(F.col("at_ms") / F.lit(1000 // max_packets)).alias("slot")
    return sends.groupBy("client", slot).agg(F.count("*").alias("n"), F.max("at_ms").alias("last_ms"))


def rate_shape(sends: DataFrame, rate: int, interval_ms: int) -> DataFrame:
    """When each message (client, seq, at_ms, bytes) leaves: not before it is there, nor before the one ahead has had
    ``bytes * 1000 / rate`` and at least ``interval_ms`` milliseconds, nor before 0.

    A message leaves when the latest of those before it to arrive, or itself, and all the time that the messages from there on take, are
    over: with B the busy time of all messages ahead, at B + max(at - B) up to here. Two running windows, no fold.
    """
    order = Window.partitionBy("client").orderBy("seq")
    busy = F.greatest(F.floor(F.col("bytes") * 1000 / rate), F.lit(interval_ms).cast("long"))
    ahead = F.coalesce(F.sum(busy).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    placed = sends.withColumn("__ahead", ahead)
    latest = F.max(F.col("at_ms") - F.col("__ahead")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    leaves = F.col("__ahead") + F.greatest(latest, F.lit(0).cast("long"))
    return placed.select("client", F.col("seq").cast("long").alias("seq"), leaves.cast("long").alias("leaves_ms"))


def sign_extend(value: Column, bits: int) -> Column:
    """A ``bits`` wide field read as a signed number."""
    return F.shiftright(F.shiftleft(value.cast("long"), 64 - bits), 64 - bits)


def latest_state(states: DataFrame) -> DataFrame:
    """The newest state of each entity; older ones are superseded."""
    return states.groupBy("entity").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))


def matrix_fill(spark, rows: int, columns: int) -> DataFrame:
    """(i, row): a matrix whose cell (i, j) is ``i * columns + j``, row by row."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda j: (F.col("id") * columns + j).cast("int"))
    return spark.range(rows).select(F.col("id").alias("i"), cells.alias("row"))


def resend_state(clients: DataFrame) -> DataFrame:
    """Clients (client, ack, state_msg, active) that must get the whole state again: they acknowledge a message beyond
    the one that carried it, and still are not active."""
    return clients.withColumn("resend", (F.col("ack") > F.col("state_msg")) & ~F.col("active"))


def message_queue(sends: DataFrame, piece_ms: int, size: int = FRAGMENT) -> DataFrame:
    """When each message (client, seq, at_ms, bytes) starts and has left, one piece each ``piece_ms`` milliseconds.

    No piece of a message goes before all of the one ahead have gone: until then it is queued as it is. As in
    ``rate_shape``, two running windows.
    """
    order = Window.partitionBy("client").orderBy("seq")
    pieces = F.floor(F.col("bytes") / size) + 1
    ahead = F.coalesce(F.sum(pieces * piece_ms).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    placed = sends.withColumn("__pieces", pieces).withColumn("__ahead", ahead)
    start = F.col("__ahead") + F.max(F.col("at_ms") - F.col("__ahead")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    timed = placed.withColumn("starts_ms", start)
    return timed.select(
        "client", "seq", F.col("__pieces").alias("pieces"), (F.col("starts_ms") > F.col("at_ms")).alias("queued"), "starts_ms",
        (F.col("starts_ms") + F.col("__pieces") * piece_ms).alias("left_ms"),
    )


def signed_fields(values: DataFrame, bits: int) -> DataFrame:
    """(id, field, overflow) of each (id, value): the value as a field of ``bits`` bits holds it, and whether it lost some."""
    held = sign_extend(F.col("value"), bits)
    return values.select("id", held.alias("field"), (held != F.col("value")).alias("overflow"))
