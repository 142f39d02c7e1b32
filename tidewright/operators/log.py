"""The sequenced log: scans, recovery, sequence audit, gap ranges, repair, resume and catch-up.

A log is a table with one row per ``seq``; channels number their rows apart. Every order is total: ties of arrival
fall to the sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a subscriber is sent in one round.
BATCH = 10
#: Arrivals of a range that one task judges, about, and ranges at most.
RANGE_ROWS, MOST_RANGES = 10_000, 200
#: Requests for repair beyond which a subscriber asks for regrouping.
NACK_LIMIT = 5


def point(log: DataFrame, seq: int) -> DataFrame:
    """The row of one sequence; no row if it is missing."""
    return log.where(F.col("seq") == seq)


def between(log: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of an inclusive range of sequences, ascending. The range reaches the Parquet scan."""
    return log.where(F.col("seq").between(start, end)).orderBy("seq")


def recover(log: DataFrame) -> DataFrame:
    """The sequence at which a log goes on: the largest stored, or 0."""
    return log.agg(F.coalesce(F.max("seq"), F.lit(0).cast("long")).alias("current_seq"))


def assign(messages: DataFrame, channel: str, *order: str) -> DataFrame:
    """Number each channel's messages from 1 in the given total order."""
    return messages.withColumn("seq", F.row_number().over(Window.partitionBy(channel).orderBy(*order)).cast("long"))


def verdict(seq: Column, expected: Column) -> list[Column]:
    """Audit columns of a message against the sequence its channel expects next."""
    gap = seq > expected
    return [
        F.when(seq == expected, "in_order").when(gap, "gap").otherwise("stale").alias("verdict"),
        F.when(gap, expected).alias("nack_start"),
        F.when(gap, seq - 1).alias("nack_end"),
    ]


def _range_of(value: Column, cuts: list) -> Column:
    """How many of the ascending cuts lie below the value, by a tree of comparisons."""

    def part(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value > F.lit(cuts[middle]), part(middle + 1, high)).otherwise(part(low, middle))

    return part(0, len(cuts))


def sequence_audit(arrivals: DataFrame, ranges: int | None = None) -> DataFrame:
    """Judge every arrival (channel, seq, arrival) as in order, gap or stale.

    A channel expects one more than the largest sequence it has seen, and 1 at first. A gap carries the
    inclusive range to ask for again. Ties of ``arrival`` fall to ``seq``.

    A channel is cut into ranges of arrival, each judged by a task of its own from the largest sequence of the ranges
    before. Their number goes by the counted arrivals unless given: one for each ``RANGE_ROWS``, and ``MOST_RANGES`` at
    most, beyond which ranges grow.
    """
    cuts: list = []
    if ranges is None or ranges > 1:
        grid = MOST_RANGES if ranges is None else ranges
        n, found = arrivals.agg(F.count("*"), F.approx_percentile("arrival", [k / grid for k in range(1, grid)])).first()
        ranges = min(grid, n // RANGE_ROWS + 1) if ranges is None else ranges
        cuts = sorted({(found or [])[k * grid // ranges - 1] for k in range(1, ranges)}) if found else []
    if cuts:
        arrivals = arrivals.withColumn("__range", _range_of(F.col("arrival"), cuts))
        earlier = Window.partitionBy("channel").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        tops = arrivals.groupBy("channel", "__range").agg(F.max("seq").alias("top"))
        tops = tops.select("channel", "__range", F.coalesce(F.max("top").over(earlier), F.lit(0)).alias("__seen"))
        arrivals = arrivals.join(tops, ["channel", "__range"])
    else:
        arrivals = arrivals.withColumn("__range", F.lit(0)).withColumn("__seen", F.lit(0).cast("long"))
    before = Window.partitionBy("channel", "__range").orderBy("arrival", "seq").rowsBetween(Window.unboundedPreceding, -1)
    expected = F.greatest(F.coalesce(F.max("seq").over(before), F.lit(0)), F.col("__seen")) + 1
    seen = arrivals.withColumn("expected", expected)
    return seen.select("channel", "arrival", "seq", "expected", *verdict(F.col("seq"), F.col("expected")))


def nack_ranges(audit: DataFrame) -> DataFrame:
    """The ranges to ask for again, in the order in which the gaps were seen."""
    return audit.where("verdict = 'gap'").select("channel", "arrival", "nack_start", "nack_end")


def retransmit(nacks: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of the log inside any requested range, once each.

    Ranges become sequences and meet the log by equality, so the join hashes on (channel, seq) whatever the number
    of ranges.
    """
    wanted = nacks.select("channel", F.explode(F.sequence("nack_start", "nack_end")).alias("seq")).distinct()
    return log.join(wanted, ["channel", "seq"], "left_semi")


def repair(arrivals: DataFrame, log: DataFrame) -> DataFrame:
    """What a channel holds once its gaps are filled: every sequence once, delivered or sent again."""
    audit = sequence_audit(arrivals)
    delivered = audit.select("channel", "seq").distinct().withColumn("repaired", F.lit(False))
    again = retransmit(nack_ranges(audit), log).select("channel", "seq").withColumn("repaired", F.lit(True))
    both = delivered.unionByName(again)
    return both.groupBy("channel", "seq").agg(F.min("repaired").alias("repaired"))


def contiguity(rows: DataFrame) -> DataFrame:
    """Per channel: distinct sequences, first, last, and whether none is missing between."""
    out = rows.groupBy("channel").agg(
        F.countDistinct("seq").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )
    return out.withColumn("contiguous", F.col("last_seq") - F.col("first_seq") + 1 == F.col("n"))


def resume(log: DataFrame, subscribers: DataFrame) -> DataFrame:
    """What each subscriber (subscriber, channel, last_recv) is still to get: all of its channel after ``last_recv``.

    A subscriber that never received anything has 0 or null and replays from the start.
    """
    from_seq = F.coalesce("last_recv", F.lit(0))
    return log.join(subscribers, "channel").where(F.col("seq") > from_seq).select("subscriber", "channel", "seq")


def catch_up(log: DataFrame, sessions: DataFrame, batch: int = BATCH) -> DataFrame:
    """One round of each active session (subscriber, next_send, target, active): up to ``batch`` rows from ``next_send``.

    Missing sequences are skipped. A session's range holds at most ``batch`` numbers, so it is spread out and met by
    equality, not by a nested loop.
    """
    due = sessions.where("active AND next_send <= target")
    last = F.least("target", F.col("next_send") + batch - 1)
    wanted = due.select("subscriber", F.explode(F.sequence("next_send", last)).alias("seq"))
    return wanted.join(log, "seq").select("subscriber", "seq", *[c for c in log.columns if c != "seq"])


def progress(sessions: DataFrame, acks: DataFrame, nacks: DataFrame) -> DataFrame:
    """Each session's next sequence: moved on by acknowledgements only, then back to the least one asked for again.

    ``needs_regroup`` marks sessions that asked more than ``NACK_LIMIT`` times.
    """
    acked = acks.groupBy("subscriber").agg(F.max("last_recv").alias("last_recv"))
    asked = nacks.groupBy("subscriber").agg(F.min("nack_start").alias("nack_start"), F.count("*").alias("nack_count"))
    moved = sessions.join(acked, "subscriber", "left").join(asked, "subscriber", "left")
    ahead = F.greatest("next_send", F.coalesce(F.col("last_recv") + 1, F.col("next_send")))
    count = F.coalesce("nack_count", F.lit(0))
    return moved.select(
        "subscriber", F.least(ahead, F.coalesce("nack_start", ahead)).alias("next_send"), count.alias("nack_count"),
        (count > NACK_LIMIT).alias("needs_regroup"),
    )


def due_now(sends: DataFrame, spacing_us: int = 1000) -> DataFrame:
    """Whether each send (subscriber, at_us) keeps the least spacing from the one before."""
    before = F.lag("at_us").over(Window.partitionBy("subscriber").orderBy("at_us"))
    return sends.withColumn("due", F.coalesce(F.col("at_us") - before >= spacing_us, F.lit(True)))


def well_formed(rows: DataFrame, size: int, value: str = "value") -> DataFrame:
    """Rows whose binary value has the size of its record; others are left out, as a scan of the log does."""
    return rows.where(F.octet_length(value) == size)


def dispatch(messages: DataFrame, handlers: dict[str, str]) -> DataFrame:
    """Name each message's handler by its type; messages of unknown type have none."""
    pairs = F.create_map(*[F.lit(x) for pair in handlers.items() for x in pair])
    return messages.withColumn("handler", F.element_at(pairs, F.col("msg_type")))


def advance_targets(sessions: DataFrame, log: DataFrame) -> DataFrame:
    """Each session's target moved to its channel's newest sequence, and whether it has rows to catch up on."""
    newest = log.groupBy("channel").agg(F.max("seq").alias("newest"))
    moved = sessions.join(newest, "channel", "left").withColumn("target", F.greatest("target", F.coalesce("newest", "target")))
    return moved.drop("newest").withColumn("catching_up", F.col("next_send") <= F.col("target"))


def throughput(rows: DataFrame) -> DataFrame:
    """Messages, seconds from the first to the last, and messages a second, of each channel (channel, ts)."""
    out = rows.groupBy("channel").agg(
        F.count("*").alias("n"), ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6).alias("seconds")
    )
    return out.withColumn("per_second", F.col("n") / F.nullif(F.col("seconds"), F.lit(0.0)))


def counters(audit: DataFrame) -> DataFrame:
    """Per channel: arrivals in order, beyond a gap, and stale ones that are discarded; sequences that the gaps skipped."""
    kind = lambda name: F.count_if(F.col("verdict") == name)
    skipped = F.coalesce(F.sum(F.col("nack_end") - F.col("nack_start") + 1), F.lit(0).cast("long"))
    return audit.groupBy("channel").agg(
        kind("in_order").alias("ordered"), kind("gap").alias("after_gap"), kind("stale").alias("stale"), skipped.alias("dropped")
    )


def heartbeats(rows: DataFrame, every_s: int = 5) -> DataFrame:
    """The heartbeats of each channel (channel, ts, seq): one every ``every_s`` seconds of the epoch from its first message
    on to its last, with the newest sequence up to then.

    Only the slots that hold messages are ordered within a channel; those between are spread out afterwards.
    """
    width = every_s * 1_000_000
    at = F.expr(f"(unix_micros(cast(ts AS timestamp)) + {width - 1}) div {width}")
    slots = rows.groupBy("channel", at.alias("slot")).agg(F.max("seq").alias("seq"))
    order = Window.partitionBy("channel").orderBy("slot")
    held = slots.select("channel", "slot", F.max("seq").over(order).alias("newest_seq"), F.coalesce(F.lead("slot").over(order) - 1, "slot").alias("last"))
    spread = held.select("channel", F.explode(F.sequence("slot", "last")).alias("slot"), "newest_seq")
    return spread.select("channel", (F.col("slot") * every_s).alias("at_s"), "newest_seq")
