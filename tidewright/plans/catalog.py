"""The registered queries of the library itself, with the DuckDB text that each must agree with.

The driver's tables stand for the library's: ``events`` for ticks, log rows and heartbeats (user: security, subscriber or
client; event type: channel), ``orders`` for executions, ``lineitem`` for tasks, ``customer`` for workflows, ``documents``
for blobs and messages. Queries run over whole tables; where a query is about loss (audit, repair, catch-up, reassembly),
lost rows are set by a rule on ids, as part of what the query simulates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import bytes as B
from tidewright.functions import scalar
from tidewright.operators import codecs, dag, extensions, log, workflows, sessions, snapshots, ticks, triggers
from tidewright.registry import Registry
from tidewright.session import scratch_folder, table
from tidewright.sources.kvstore import KeyValueStore
from tidewright.sources.stores import EventLog
from tidewright.streaming import stateful

REGISTRY = Registry()
query = REGISTRY.query


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


# ---------------------------------------------------------------- ordered streams


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr("user_id AS skey", "ts", "event_id + 1 AS seq", "value AS price", "event_type AS side")


@query(
    "merged_ticks",
    "SELECT user_id AS skey, ts, event_id + 1 AS seq, value AS price, event_type AS side FROM events ORDER BY ts, skey, seq",
)
def _merged_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks.merged(_ticks(spark, sf_dir))


@query(
    "tick_positions",
    "SELECT user_id AS skey, event_id + 1 AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events",
)
def _tick_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks.positions(_ticks(spark, sf_dir)).selectExpr("skey", "seq", "cast(pos AS long) AS pos")


@query(
    "tick_monotonic",
    """WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY (event_id * 7919) % 1009, event_id) AS p FROM events)
    SELECT user_id AS skey, count(*) AS n, count(*) FILTER (ts < p) AS violations FROM o GROUP BY user_id""",
)
def _tick_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ticks(spark, sf_dir).withColumn("o", F.expr("((seq - 1) * 7919) % 1009"))
    return ticks.violations(rows, "o", "seq")


@query("stream_counts", "SELECT user_id AS skey, count(*) AS n FROM events GROUP BY user_id")
def _stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks.counts(_ticks(spark, sf_dir))


@query(
    "key_listing",
    "SELECT DISTINCT 'mdl/mbd/order/' || strftime(ts, '%Y%m%d') || '/' || user_id || '.parquet' AS key FROM events "
    "WHERE strftime(ts, '%Y%m%d') = '20240103'",
)
def _key_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks.listing(_ticks(spark, sf_dir), "mdl/mbd/order/20240103/")


@query(
    "day_discovery",
    "SELECT strftime(ts, '%Y%m%d') AS day, count(DISTINCT user_id) AS streams, min(user_id) AS first_key, max(user_id) AS last_key "
    "FROM events GROUP BY 1",
)
def _day_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks.discovery(_ticks(spark, sf_dir))


@query("full_sort_desc", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey")
def _full_sort_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return rows.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")


# ---------------------------------------------------------------- the log

_ARRIVALS = """arrivals AS (
      SELECT event_type AS channel, event_id + 1 AS seq, event_id + (event_id * 7919) % 11 AS arrival
      FROM events WHERE event_id % 37 <> 5
    )"""
_AUDIT = f"""{_ARRIVALS}, seen AS (
      SELECT *, coalesce(max(seq) OVER (PARTITION BY channel ORDER BY arrival, seq
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS expected
      FROM arrivals
    ), audit AS (
      SELECT channel, arrival, seq, expected,
             CASE WHEN seq = expected THEN 'in_order' WHEN seq > expected THEN 'gap' ELSE 'stale' END AS verdict,
             CASE WHEN seq > expected THEN expected END AS nack_start,
             CASE WHEN seq > expected THEN seq - 1 END AS nack_end
      FROM seen
    )"""
_CHANNEL_LOG = "SELECT event_type AS channel, event_id + 1 AS seq FROM events"


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a lossy, reordered delivery of a sequenced log."""
    return _events(spark, sf_dir).where("event_id % 37 <> 5").selectExpr(
        "event_type AS channel", "event_id + 1 AS seq", "event_id + (event_id * 7919) % 11 AS arrival"
    )


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr("event_type AS channel", "event_id + 1 AS seq", "value", "user_id")


def _stored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log keyed by the stored column itself, so that ranges reach the scan."""
    return _events(spark, sf_dir).selectExpr("event_id AS seq", "event_type AS channel", "value", "user_id")


@query("log_point", "SELECT event_id AS seq, event_type AS channel, value, user_id FROM events WHERE event_id = 42")
def _log_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.point(_stored_log(spark, sf_dir), 42)


@query("log_range", "SELECT event_id AS seq, event_type AS channel, value, user_id FROM events WHERE event_id BETWEEN 300 AND 700")
def _log_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.between(_stored_log(spark, sf_dir), 300, 700)


@query("log_recover", "SELECT coalesce(max(event_id + 1), 0) AS current_seq FROM events")
def _log_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.recover(_log(spark, sf_dir))


@query("published_log", "SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, event_id, event_type, props FROM events")
def _published_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events published to a new log and read back."""
    store = EventLog(spark, scratch_folder(spark), "ts timestamp_ntz, event_id long, event_type string, props string")
    store.publish(_events(spark, sf_dir).select("ts", "event_id", "event_type", "props"), "ts", "event_id")
    return store.rows().select("seq", "event_id", "event_type", "props")


@query("seq_assign", "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq FROM events")
def _seq_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.assign(_events(spark, sf_dir), "event_type", "ts", "event_id").select("event_id", "event_type", "seq")


@query("sequence_audit", f"WITH {_AUDIT} SELECT * FROM audit")
def _sequence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.sequence_audit(arrivals(spark, sf_dir))


@query("nack_ranges", f"WITH {_AUDIT} SELECT channel, arrival, nack_start, nack_end FROM audit WHERE verdict = 'gap'")
def _nack_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.nack_ranges(log.sequence_audit(arrivals(spark, sf_dir)))


@query(
    "retransmit",
    f"""WITH {_AUDIT}, log AS ({_CHANNEL_LOG})
    SELECT DISTINCT log.channel, log.seq FROM log JOIN audit a ON a.channel = log.channel AND log.seq BETWEEN a.nack_start AND a.nack_end""",
)
def _retransmit(spark: SparkSession, sf_dir: str) -> DataFrame:
    channel_log = _log(spark, sf_dir).select("channel", "seq")
    return log.retransmit(log.nack_ranges(log.sequence_audit(arrivals(spark, sf_dir))), channel_log)


@query(
    "repaired_log",
    f"""WITH {_AUDIT}, log AS ({_CHANNEL_LOG}), held AS (
      SELECT channel, seq, false AS repaired FROM arrivals
      UNION ALL
      SELECT log.channel, log.seq, true FROM log JOIN audit a ON a.channel = log.channel AND log.seq BETWEEN a.nack_start AND a.nack_end
    ) SELECT channel, seq, bool_and(repaired) AS repaired FROM held GROUP BY channel, seq""",
)
def _repaired_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.repair(arrivals(spark, sf_dir), _log(spark, sf_dir).select("channel", "seq"))


@query(
    "contiguity",
    f"""WITH {_ARRIVALS} SELECT channel, count(DISTINCT seq) AS n, min(seq) AS first_seq, max(seq) AS last_seq,
    max(seq) - min(seq) + 1 = count(DISTINCT seq) AS contiguous FROM arrivals GROUP BY channel""",
)
def _contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.contiguity(arrivals(spark, sf_dir))


@query(
    "subscribe_resume",
    """WITH s AS (SELECT user_id AS subscriber, event_type AS channel, CASE WHEN user_id % 5 = 0 THEN NULL ELSE max(event_id) - 20 END AS last_recv
                  FROM events GROUP BY 1, 2)
    SELECT s.subscriber, s.channel, e.event_id + 1 AS seq FROM s JOIN events e ON e.event_type = s.channel AND e.user_id = s.subscriber
    WHERE e.event_id + 1 > coalesce(s.last_recv, 0)""",
)
def _subscribe_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).withColumn("own", F.concat_ws("/", "user_id", "event_type"))
    subscribers = events.groupBy("own").agg(F.min("user_id").alias("subscriber"), F.min("event_type").alias("type"), F.max("event_id").alias("last"))
    subscribers = subscribers.selectExpr("own AS channel", "subscriber", "type", "CASE WHEN subscriber % 5 <> 0 THEN last - 20 END AS last_recv")
    out = log.resume(events.selectExpr("own AS channel", "event_id + 1 AS seq"), subscribers)
    return out.selectExpr("subscriber", "split(channel, '/')[1] AS channel", "seq")


_SESSIONS = """s AS (SELECT user_id AS subscriber, min(event_id) + 1 AS next_send, min(event_id) + 1 + user_id % 15 AS target,
                        user_id % 7 <> 3 AS active FROM events GROUP BY user_id)"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("user_id").agg(F.min("event_id").alias("e")).selectExpr(
        "user_id AS subscriber", "e + 1 AS next_send", "e + 1 + user_id % 15 AS target", "user_id % 7 <> 3 AS active"
    )


@query(
    "catchup_batch",
    f"""WITH {_SESSIONS} SELECT s.subscriber, e.event_id + 1 AS seq, e.value FROM s
    JOIN (SELECT * FROM events WHERE event_id % 37 <> 5) e ON e.event_id + 1 BETWEEN s.next_send AND least(s.target, s.next_send + 9)
    WHERE s.active AND s.next_send <= s.target""",
)
def _catchup_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir).where("(seq - 1) % 37 <> 5").select("seq", "value")
    return log.catch_up(rows, _sessions(spark, sf_dir))


@query(
    "ack_progress",
    f"""WITH {_SESSIONS}, acks AS (SELECT user_id AS subscriber, event_id + 1 AS last_recv FROM events WHERE event_type = 'click'),
    nacks AS (SELECT user_id AS subscriber, event_id AS nack_start FROM events WHERE event_type = 'view'),
    a AS (SELECT subscriber, max(last_recv) AS last_recv FROM acks GROUP BY 1),
    k AS (SELECT subscriber, min(nack_start) AS nack_start, count(*) AS n FROM nacks GROUP BY 1)
    SELECT s.subscriber,
      least(greatest(s.next_send, coalesce(a.last_recv + 1, s.next_send)),
            coalesce(k.nack_start, greatest(s.next_send, coalesce(a.last_recv + 1, s.next_send)))) AS next_send,
      coalesce(k.n, 0) AS nack_count, coalesce(k.n, 0) > 5 AS needs_regroup
    FROM s LEFT JOIN a USING (subscriber) LEFT JOIN k USING (subscriber)""",
)
def _ack_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    acks = events.where("event_type = 'click'").selectExpr("user_id AS subscriber", "event_id + 1 AS last_recv")
    nacks = events.where("event_type = 'view'").selectExpr("user_id AS subscriber", "event_id AS nack_start")
    return log.progress(_sessions(spark, sf_dir), acks, nacks)


@query(
    "send_pacing",
    """WITH t AS (SELECT user_id AS subscriber, event_id, epoch_us(ts) AS at_us FROM events)
    SELECT subscriber, event_id, coalesce(at_us - lag(at_us) OVER (PARTITION BY subscriber ORDER BY at_us) >= 3600000000, true) AS due FROM t""",
)
def _send_pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sends = _events(spark, sf_dir).selectExpr("user_id AS subscriber", "event_id", "unix_micros(cast(ts AS timestamp)) AS at_us")
    return log.due_now(sends, 3_600_000_000).select("subscriber", "event_id", "due")


# ---------------------------------------------------------------- sessions and groups


@query(
    "heartbeat_timeout",
    """SELECT user_id AS subscriber, max(ts) AS last_seen, max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE * 24 AS active
    FROM events GROUP BY user_id""",
)
def _heartbeat_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    now = F.lit(events.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    return sessions.heartbeat_timeout(events.selectExpr("user_id AS subscriber", "ts AS at"), now, "INTERVAL 12 HOURS")


_MEMBERS = """m AS (SELECT 'all' AS channel, CAST(user_id AS VARCHAR) AS subscriber, max(event_id) AS next_send, user_id % 7 <> 3 AS active,
      '10.0.' || (user_id % 4) || '.' || (user_id % 250 + 1) AS ip, CAST(user_id % 3 AS INTEGER) AS priority
    FROM events GROUP BY user_id)"""
_GROUPS = f"""{_MEMBERS}, o AS (
      SELECT *, row_number() OVER (PARTITION BY channel ORDER BY next_send, subscriber) AS i FROM m
    ), g AS (
      SELECT channel, subscriber, next_send, active, i, next_send AS anchor, 1 AS size, 0 AS n FROM o WHERE i = 1
      UNION ALL
      SELECT o.channel, o.subscriber, o.next_send, o.active, o.i,
             CASE WHEN o.next_send - g.anchor > 100 OR g.size >= 50 THEN o.next_send ELSE g.anchor END,
             CASE WHEN o.next_send - g.anchor > 100 OR g.size >= 50 THEN 1 ELSE g.size + 1 END,
             CASE WHEN o.next_send - g.anchor > 100 OR g.size >= 50 THEN g.n + 1 ELSE g.n END
      FROM g JOIN o ON o.channel = g.channel AND o.i = g.i + 1
    ), b AS (
      SELECT channel, 'progress_' || n AS group_id, min(next_send) AS min_seq, max(next_send) AS max_seq, count(*) AS members,
             bool_and(active) AS all_active FROM g GROUP BY channel, n
    )"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("user_id").agg(F.max("event_id").alias("next_send")).selectExpr(
        "'all' AS channel", "cast(user_id AS string) AS subscriber", "next_send", "user_id % 7 <> 3 AS active",
        "concat('10.0.', user_id % 4, '.', user_id % 250 + 1) AS ip", "cast(user_id % 3 AS int) AS priority",
    )


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _members(spark, sf_dir)
    return sessions.group_bounds(sessions.progress_groups(members).join(members.select("channel", "subscriber", "active"), ["channel", "subscriber"]))


@query("progress_groups", f"WITH RECURSIVE {_GROUPS} SELECT channel, subscriber, next_send, 'progress_' || n AS group_id FROM g")
def _progress_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.progress_groups(_members(spark, sf_dir))


@query("group_bounds", f"WITH RECURSIVE {_GROUPS} SELECT * FROM b")
def _group_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounds(spark, sf_dir)


@query("regroup_needed", f"WITH RECURSIVE {_GROUPS} SELECT *, max_seq - min_seq > 80 AS regroup FROM b")
def _regroup_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.regroup_needed(_bounds(spark, sf_dir), 40)


@query(
    "group_send",
    f"WITH RECURSIVE {_GROUPS} SELECT channel, group_id, min_seq AS from_seq, least(max_seq, min_seq + 9) AS to_seq, members FROM b WHERE all_active",
)
def _group_send(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.group_send(_bounds(spark, sf_dir))


@query(
    "subnet_groups",
    f"""WITH {_MEMBERS}, s AS (SELECT *, regexp_extract(ip, '^(.*)\\.[0-9]+$', 1) AS subnet FROM m)
    SELECT channel, subnet, count(*) AS members, string_agg(DISTINCT subscriber, ',' ORDER BY subscriber) AS subscribers,
           '239.' || subnet AS multicast FROM s GROUP BY channel, subnet HAVING count(*) >= 2""",
)
def _subnet_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.subnet_groups(_members(spark, sf_dir))


_PRIORITY = f"""{_MEMBERS}, p AS (SELECT channel, subscriber, priority,
    CASE priority WHEN 2 THEN 'vip_' || subscriber WHEN 1 THEN 'high_priority' END AS group_id FROM m)"""


@query("priority_groups", f"WITH {_PRIORITY} SELECT * FROM p")
def _priority_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.priority_groups(_members(spark, sf_dir))


@query("ungrouped", f"WITH {_PRIORITY} SELECT channel, subscriber, next_send FROM m WHERE subscriber NOT IN (SELECT subscriber FROM p WHERE group_id IS NOT NULL)")
def _ungrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _members(spark, sf_dir)
    return sessions.ungrouped(members, sessions.priority_groups(members)).select("channel", "subscriber", "next_send")


_REST = _GROUPS.replace("AS i FROM m\n", "AS i FROM m WHERE priority = 0\n")


@query(
    "regroup",
    f"""WITH RECURSIVE {_REST}, k AS (SELECT channel, n, count(*) AS held FROM g GROUP BY ALL),
    a AS (SELECT m.channel, m.subscriber, 'subnet_' || regexp_replace(m.ip, '[.][0-9]+$', '') AS net FROM m JOIN g USING (channel, subscriber) JOIN k USING (channel, n) WHERE held = 1),
    l AS (SELECT channel, net, count(*) AS held FROM a GROUP BY ALL)
    SELECT channel, subscriber, CASE priority WHEN 2 THEN 'vip_' || subscriber ELSE 'high_priority' END AS group_id FROM m WHERE priority > 0
    UNION ALL SELECT channel, subscriber, 'progress_' || n FROM g JOIN k USING (channel, n) WHERE held > 1
    UNION ALL SELECT channel, subscriber, CASE WHEN l.held > 1 THEN net END FROM a JOIN l USING (channel, net)""",
)
def _regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.regroup(_members(spark, sf_dir))


_CHANNEL_STATE = (
    "count(CASE WHEN event_id % 31 = 0 THEN 1 END) % 2 AS joined, count(CASE WHEN event_id % 37 = 0 THEN 1 END) % 2 AS left, "
    "count(CASE WHEN event_id % 41 = 0 THEN 1 END) % 2 AS timed_out, count(*) % 9 AS nack_count, count(*) % 14 AS since_s, count(*) % 400 AS span"
)


@query(
    "regroup_due",
    f"""WITH s AS (SELECT user_id AS channel, {_CHANNEL_STATE.replace(" left,", ' "left",')} FROM events GROUP BY user_id),
    r AS (SELECT channel, CASE WHEN joined > 0 OR "left" > 0 THEN 'membership' WHEN timed_out > 0 THEN 'time_out' WHEN nack_count > 5 THEN 'repairs'
        WHEN since_s >= 10 THEN 'interval' WHEN span > 200 THEN 'spread' END AS reason FROM s)
    SELECT channel, reason, reason IS NOT NULL AS due FROM r""",
)
def _regroup_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = [F.expr(x.replace(" AS left", " AS `left`")) for x in _CHANNEL_STATE.split(", ")]
    return sessions.regroup_due(_events(spark, sf_dir).groupBy(F.col("user_id").alias("channel")).agg(*counted))


@query(
    "packet_session",
    f"""WITH {_MEMBERS}, a AS (SELECT ip, 9000 AS port, min(subscriber) AS subscriber FROM m GROUP BY ip)
    SELECT e.event_id, a.subscriber FROM events e LEFT JOIN a ON a.ip = '10.0.' || (e.event_id % 4) || '.' || (e.event_id % 250 + 1)
      AND a.port = CASE WHEN e.event_id % 9 = 0 THEN 1 ELSE 9000 END""",
)
def _packet_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = _events(spark, sf_dir).selectExpr("event_id", "concat('10.0.', event_id % 4, '.', event_id % 250 + 1) AS ip", "CASE WHEN event_id % 9 = 0 THEN 1 ELSE 9000 END AS port")
    return sessions.session_of_packet(packets, _members(spark, sf_dir).withColumn("port", F.lit(9000))).select("event_id", "subscriber")


@query(
    "group_fanout",
    f"""WITH RECURSIVE {_GROUPS} SELECT g.channel, b.group_id, g.subscriber AS receiver, b.min_seq AS from_seq, least(b.max_seq, b.min_seq + 9) AS to_seq
    FROM g JOIN b ON b.channel = g.channel AND b.group_id = 'progress_' || g.n WHERE b.all_active""",
)
def _group_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.fan_out(sessions.group_send(_bounds(spark, sf_dir)), sessions.progress_groups(_members(spark, sf_dir)), multicast=False)


@query(
    "advance_targets",
    """WITH s AS (SELECT user_id AS subscriber, event_type AS channel, min(event_id) AS target, max(event_id) - user_id % 5 + 3 AS next_send FROM events GROUP BY 1, 2),
    n AS (SELECT event_type AS channel, max(event_id) AS newest FROM events GROUP BY 1)
    SELECT subscriber, s.channel, next_send, greatest(target, newest) AS target, next_send <= greatest(target, newest) AS catching_up FROM s JOIN n ON n.channel = s.channel""",
)
def _advance_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    known = events.groupBy(F.col("user_id").alias("subscriber"), F.col("event_type").alias("channel")).agg(
        F.min("event_id").alias("target"), (F.max("event_id") - F.col("user_id") % 5 + 3).alias("next_send")
    )
    return log.advance_targets(known, _stored_log(spark, sf_dir)).select("subscriber", "channel", "next_send", "target", "catching_up")


@query(
    "channel_throughput",
    """SELECT event_type AS channel, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds,
    round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS per_second FROM events GROUP BY 1""",
)
def _channel_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = log.throughput(_events(spark, sf_dir).select(F.col("event_type").alias("channel"), "ts"))
    return out.withColumn("per_second", F.round("per_second", 9))


@query("well_formed", "SELECT event_id FROM events WHERE octet_length(encode(props)) = 20")
def _well_formed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.well_formed(_events(spark, sf_dir), 20, "props").select("event_id")


@query(
    "message_dispatch",
    "SELECT event_id, CASE event_type WHEN 'click' THEN 'deliver' WHEN 'view' THEN 'retransmit' WHEN 'purchase' THEN 'subscribe' END AS handler FROM events",
)
def _message_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _events(spark, sf_dir).withColumnRenamed("event_type", "msg_type")
    return log.dispatch(messages, {"click": "deliver", "view": "retransmit", "purchase": "subscribe"}).select("event_id", "handler")


@query(
    "state_resend",
    """SELECT user_id AS client, max(event_id) > 9000 + user_id AND count(*) % 2 <> 0 AS resend FROM events GROUP BY user_id""",
)
def _state_resend(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = _events(spark, sf_dir).groupBy(F.col("user_id").alias("client")).agg(
        F.max("event_id").alias("ack"), (F.col("user_id") + 9000).alias("state_msg"), (F.count("*") % 2 == 0).alias("active")
    )
    return snapshots.resend_state(clients).select("client", "resend")


# ---------------------------------------------------------------- workflows and execution history

_EXECUTIONS = """x AS (SELECT o_orderkey AS id, o_custkey AS workflow_version_id, o_orderdate AS created_at, o_orderdate + INTERVAL 90 SECOND AS updated_at,
    CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'F' THEN 'success' ELSE 'failed' END AS status FROM orders)"""
_STATUS = "CASE l_returnflag WHEN 'R' THEN 'failed' ELSE 'success' END"


def _executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS workflow_version_id", "o_orderdate AS created_at", "o_orderdate + INTERVAL 90 SECOND AS updated_at",
        "CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'F' THEN 'success' ELSE 'failed' END AS status",
    )


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS execution_id", "concat_ws('-', 'task', l_linenumber, l_partkey, l_suppkey) AS task_name", f"{_STATUS} AS status"
    )


@query(
    "history_90d",
    f"""WITH {_EXECUTIONS} SELECT id, status, CASE WHEN status NOT IN ('skipped', 'pending') THEN strftime(created_at, '%Y-%m-%d %H:%M:%S') END AS start_time,
      CASE WHEN status IN ('success', 'failed') THEN strftime(updated_at, '%Y-%m-%d %H:%M:%S') END AS end_time
    FROM x WHERE created_at > (SELECT max(created_at) FROM x) - INTERVAL 90 DAY""",
)
def _history_90d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _executions(spark, sf_dir)
    now = F.lit(rows.agg(F.max("created_at")).first()[0]).cast("timestamp_ntz")
    return workflows.times(workflows.history(rows, now)).select("id", "status", "start_time", "end_time")


@query(
    "history_join",
    f"""WITH {_EXECUTIONS}, v AS (SELECT c_custkey + 50 AS id, c_nationkey AS workflow_id FROM customer)
    SELECT x.id, x.status, coalesce(v.workflow_id, 0) AS workflow_id FROM x LEFT JOIN v ON v.id = x.workflow_version_id""",
)
def _history_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "customer").selectExpr("c_custkey + 50 AS id", "c_nationkey AS workflow_id")
    return workflows.with_workflow(_executions(spark, sf_dir), versions).select("id", "status", "workflow_id")


_VERSIONS = """v AS (SELECT o_orderkey AS id, o_custkey AS workflow_id, o_orderpriority AS config,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS version FROM orders)"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey AS workflow_id", "o_orderpriority AS config", "o_orderdate AS created_at")
    return workflows.version_numbers(rows, "created_at", "id")


@query("version_number", f"WITH {_VERSIONS} SELECT id, workflow_id, version FROM v")
def _version_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).selectExpr("id", "workflow_id", "cast(version AS long) AS version")


@query(
    "latest_version",
    f"""WITH {_VERSIONS}, p AS (SELECT workflow_id, max(version) AS latest_version FROM v GROUP BY 1)
    SELECT p.workflow_id, p.latest_version, v.id AS version_id, v.config FROM p JOIN v ON v.workflow_id = p.workflow_id AND v.version = p.latest_version""",
)
def _latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = _versions(spark, sf_dir).withColumn("version", F.col("version").cast("long"))
    known = versions.groupBy(F.col("workflow_id").alias("id")).agg(F.max("version").alias("latest_version"))
    return workflows.latest_versions(known, versions)


@query(
    "execution_detail",
    f"""WITH {_EXECUTIONS}, t AS (SELECT l_orderkey AS execution_id, concat_ws('-', 'task', l_linenumber, l_partkey, l_suppkey) AS task_name, {_STATUS} AS status FROM lineitem),
    l AS (SELECT execution_id, count(*) AS n_tasks, string_agg(task_name || ':' || status, ',' ORDER BY task_name, status) AS tasks FROM t GROUP BY 1)
    SELECT x.id, x.status, coalesce(l.n_tasks, 0) AS n_tasks, coalesce(l.tasks, '') AS tasks FROM x LEFT JOIN l ON l.execution_id = x.id""",
)
def _execution_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflows.detail(_executions(spark, sf_dir), _tasks(spark, sf_dir)).select("id", "status", "n_tasks", "tasks")


@query(
    "upsert_status",
    f"""WITH {_EXECUTIONS}, c AS (SELECT id, status, 0 AS version FROM x UNION ALL SELECT id + CASE WHEN id % 10 = 0 THEN 100000000 ELSE 0 END, 'success', 1 FROM x WHERE status = 'running')
    SELECT id, arg_max(status, version) AS status, max(version) AS version FROM c GROUP BY id""",
)
def _upsert_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _executions(spark, sf_dir)
    current = rows.select("id", "status", F.lit(0).alias("version"))
    changes = rows.where("status = 'running'").selectExpr("id + CASE WHEN id % 10 = 0 THEN 100000000 ELSE 0 END AS id", "'success' AS status", "1 AS version")
    return workflows.upsert(current, changes, ["id"], "version")


@query("insert_absent", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    return workflows.insert_absent(current, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), ["id"])


@query(
    "status_rollup",
    f"""WITH t AS (SELECT l_orderkey AS execution_id, {_STATUS} AS status FROM lineitem)
    SELECT execution_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'success' END AS status, count(*) AS n_tasks FROM t GROUP BY 1""",
)
def _status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflows.roll_up(_tasks(spark, sf_dir))


@query(
    "latest_status",
    """SELECT CAST(user_id AS VARCHAR) AS execution_id, event_type AS task_name, arg_max(props, event_id) AS status, max(event_id) AS event_seq
    FROM events GROUP BY 1, 2""",
)
def _latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).selectExpr("cast(user_id AS string) AS execution_id", "event_type AS task_name", "props AS status", "event_id AS event_seq")
    return workflows.latest_status(rows)


@query("soft_delete", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F'")
def _soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS deleted_at")
    return workflows.live(rows).select("id")


@query("keyed_fetch", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_name = 'Customer#000000042' ORDER BY id LIMIT 1")
def _keyed_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflows.one(table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name"), name="Customer#000000042")


@query(
    "history_report",
    f"""WITH {_EXECUTIONS} SELECT printf('%-5d %-15d %-15s %-15s %-20s %-20s', id, workflow_version_id, status,
      CASE id % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'cron' ELSE 'webhook' END, strftime(created_at, '%Y-%m-%d %H:%M:%S'),
      CASE WHEN status = 'running' THEN '' ELSE strftime(updated_at, '%Y-%m-%d %H:%M:%S') END) AS line FROM x""",
)
def _history_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = workflows.times(_executions(spark, sf_dir)).withColumnRenamed("workflow_version_id", "workflow_id")
    kind = F.when(F.col("id") % 3 == 0, "manual").when(F.col("id") % 3 == 1, "cron").otherwise("webhook")
    return workflows.report(rows.withColumn("trigger_type", kind))


@query(
    "response_envelope",
    """SELECT '{"code":0,"message":"success","data":{"id":' || c_custkey || ',"name":"' || c_name || '","description":"' || c_mktsegment || '","latest_version":'
      || c_nationkey || '}}' AS response FROM customer""",
)
def _response_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS description", "c_nationkey AS latest_version")
    return workflows.envelope(workflows.brief(rows))


@query("stale_requests", "SELECT event_id, event_id % 700 - 100 BETWEEN 0 AND 300 AS fresh FROM events")
def _stale_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = _events(spark, sf_dir).selectExpr("event_id", "1700000100 - event_id % 700 AS sent_at", "props AS payload", "'' AS sig")
    return triggers.verify(sent, F.lit(1_700_000_000), F.lit("key")).select("event_id", "fresh")


@query(
    "scalar_functions",
    """SELECT event_id, lpad(CAST(event_id AS VARCHAR), 20, '0') AS key, event_id & 65535 AS low, xor(xor(event_id, 77), user_id) AS command,
      (10 * 65536 + (event_id % 256) * 256 + user_id % 256) AS net, greatest(event_id, user_id) - least(event_id, user_id) AS distance FROM events""",
)
def _scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = _events(spark, sf_dir).withColumn("ip", F.expr("concat('10.', event_id % 256, '.', user_id % 256, '.9')"))
    return rows.select(
        "event_id", scalar.log_key(c("event_id")).alias("key"), c("event_id").bitwiseAND(65535).alias("low"),
        scalar.command_key(c("event_id"), F.lit(77), c("user_id")).alias("command"),
        scalar.in_subnet(scalar.address_number(c("ip"))).alias("net"), scalar.distance(c("event_id"), c("user_id")).alias("distance"),
    )


# ---------------------------------------------------------------- task graphs and triggers

_CHAIN = """c AS (SELECT l_orderkey AS dag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS level,
      CASE l_returnflag WHEN 'R' THEN 'failed' ELSE 'success' END AS outcome FROM lineitem)"""


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", f"{_STATUS} AS outcome")
    numbered = log.assign(rows, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return numbered.selectExpr("l_orderkey AS dag", "concat('t', seq) AS task", "CASE WHEN seq > 1 THEN array(concat('t', seq - 1)) ELSE array() END AS depends_on", "outcome", "seq")


@query("dag_levels", f"WITH {_CHAIN} SELECT dag, 't' || (level + 1) AS task, CAST(level AS INTEGER) AS level FROM c")
def _dag_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dag.levels(_chain(spark, sf_dir))


@query("dag_adjacency", f"WITH {_CHAIN} SELECT dag, 't' || level AS parent, 't' || (level + 1) AS children FROM c WHERE level > 0")
def _dag_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dag.adjacency(_chain(spark, sf_dir)).selectExpr("dag", "parent", "array_join(children, ',') AS children")


@query("dag_roots", "SELECT DISTINCT l_orderkey AS dag, 't1' AS task FROM lineitem")
def _dag_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dag.roots(_chain(spark, sf_dir))


@query(
    "dag_validate",
    f"""WITH {_CHAIN}, n AS (SELECT dag, max(level) AS top, CASE WHEN dag % 11 = 0 THEN 1 WHEN dag % 13 = 0 THEN 2 WHEN dag % 17 = 0 THEN 3 ELSE 0 END AS fault FROM c GROUP BY dag)
    SELECT dag, 'unknown_parent' AS problem, 't2' AS task FROM n WHERE fault IN (1, 2) AND top >= 2 OR fault = 3 AND top = 0
    UNION ALL SELECT dag, 'duplicate', 't1' FROM n WHERE fault = 2 AND top >= 1
    UNION ALL SELECT c.dag, 'cycle', 't' || (c.level + 1) FROM c JOIN n USING (dag) WHERE fault = 3 AND top >= 1""",
)
def _dag_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some graphs lose their second task's name, some have their first name twice, some close a cycle over the first two."""
    lost, twice, cycle = ((F.col("dag") % k == 0) for k in (11, 13, 17))
    task = F.when(lost & (F.col("seq") == 2), "x2").when(~lost & twice & (F.col("seq") == 2), "t1").otherwise(F.col("task"))
    above = F.when(~lost & ~twice & cycle & (F.col("seq") == 1), F.array(F.lit("t2"))).otherwise(F.col("depends_on"))
    return dag.problems(_chain(spark, sf_dir).withColumn("task", task).withColumn("depends_on", above))


_RUN_COLUMNS = (
    "CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END AS exit_code",
    "CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_discount > 0.08 THEN 2 ELSE 0 END AS check_code",
    "l_tax * 500 AS seconds",
)


@query(
    "task_outcome",
    f"""WITH r AS (SELECT l_orderkey AS dag, 't' || l_linenumber || '_' || l_partkey AS task, {', '.join(_RUN_COLUMNS)} FROM lineitem)
    SELECT dag, task, exit_code = 0 AND seconds <= 30 AND check_code IS NOT NULL AS checked,
           CASE WHEN exit_code = 0 AND seconds <= 30 AND coalesce(check_code, 0) = 0 THEN 'success' ELSE 'failed' END AS outcome FROM r""",
)
def _task_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dag.outcome(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS dag", "concat('t', l_linenumber, '_', l_partkey) AS task", *_RUN_COLUMNS))


@query(
    "status_transitions",
    """WITH e AS (SELECT user_id AS dag, event_id // 10 % 7 AS task, event_id AS event_seq,
        ['pending', 'running', 'success', 'failed', 'skipped'][event_id * 7919 % 5 + 1] AS status FROM events),
    b AS (SELECT *, lag(status) OVER (PARTITION BY dag, task ORDER BY event_seq) AS before FROM e)
    SELECT dag, task, event_seq, status, CASE WHEN before IS NULL THEN status = 'pending' WHEN before = 'pending' THEN status IN ('running', 'skipped')
        WHEN before = 'running' THEN status IN ('success', 'failed') ELSE false END AS allowed FROM b""",
)
def _status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = "element_at(array('pending', 'running', 'success', 'failed', 'skipped'), cast(event_id * 7919 % 5 + 1 AS int)) AS status"
    return dag.transitions(_events(spark, sf_dir).selectExpr("user_id AS dag", "event_id div 10 % 7 AS task", "event_id AS event_seq", status))


@query(
    "start_rounds",
    """WITH w AS (SELECT user_id AS dag, event_id % 2 AS level, 't' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS task FROM events)
    SELECT *, (row_number() OVER (PARTITION BY dag, level ORDER BY task) - 1) // 10 AS round FROM w""",
)
def _start_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dag.rounds(_events(spark, sf_dir).selectExpr("user_id AS dag", "event_id % 2 AS level", "concat('t', lpad(cast(event_id AS string), 12, '0')) AS task"))


@query(
    "result_summary",
    "SELECT event_type AS suite, count(*) FILTER (user_id % 3 > 0) AS passed, count(*) FILTER (user_id % 3 = 0) AS failed, count(*) AS total, sum(event_id % 1000) AS seconds FROM events GROUP BY 1",
)
def _result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dag.summary(_events(spark, sf_dir).selectExpr("event_type AS suite", "user_id % 3 > 0 AS passed", "event_id % 1000 AS seconds"))


@query(
    "dag_fail_fast",
    f"""WITH {_CHAIN}, f AS (SELECT *, min(CASE WHEN outcome = 'failed' THEN level END) OVER (PARTITION BY dag) AS first FROM c)
    SELECT dag, 't' || (level + 1) AS task, level, CASE WHEN level > first THEN 'skipped' ELSE outcome END AS status FROM f""",
)
def _dag_fail_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dag.fail_fast(_chain(spark, sf_dir).withColumn("level", F.col("seq") - 1))


@query(
    "dag_ready",
    f"""WITH {_CHAIN} SELECT c.dag, 't' || (c.level + 1) AS task FROM c LEFT JOIN c p ON p.dag = c.dag AND p.level = c.level - 1
    WHERE c.level % 2 = 0 AND (c.level = 0 OR p.outcome = 'success')""",
)
def _dag_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = _chain(spark, sf_dir)
    return dag.ready(chain, chain.selectExpr("dag", "task", "CASE WHEN (seq - 1) % 2 = 0 THEN 'pending' ELSE outcome END AS status"))


@query(
    "webhook_verify",
    """WITH r AS (SELECT event_id, 1700000000 - event_id % 700 + 100 AS sent_at, props AS payload,
        CASE WHEN event_id % 5 = 0 THEN 'no' ELSE sha256((1700000000 - event_id % 700 + 100) || '.' || props || '.' || 'key') END AS sig FROM events)
    SELECT event_id, 1700000000 - sent_at BETWEEN 0 AND 300 AS fresh, sig = sha256(sent_at || '.' || payload || '.key') AS signed,
           1700000000 - sent_at BETWEEN 0 AND 300 AND sig = sha256(sent_at || '.' || payload || '.key') AS accepted FROM r""",
)
def _webhook_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = _events(spark, sf_dir).selectExpr("event_id", "1700000000 - event_id % 700 + 100 AS sent_at", "props AS payload")
    signed = F.when(F.col("event_id") % 5 == 0, "no").otherwise(triggers.signature(F.col("sent_at"), F.col("payload"), F.lit("key")))
    return triggers.verify(sent.withColumn("sig", signed), F.lit(1_700_000_000), F.lit("key")).select("event_id", "fresh", "signed", "accepted")


_DEFINED = "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE (c_custkey % 60) || ' * * * *' END"


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cron = "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat(c_custkey % 60, ' * * * *') END"
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", f"array(named_struct('cron', '', 'webhook', concat('/hook/', c_nationkey)), named_struct('cron', {cron}, 'webhook', '')) AS triggers"
    )


@query("trigger_match", "SELECT c_custkey AS id FROM customer WHERE list_contains(['/hook/' || c_nationkey, ''], '/hook/7')")
def _trigger_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.matching(_definitions(spark, sf_dir), F.lit("/hook/7")).select("id")


@query("cron_schedules", f"SELECT c_custkey AS id, {_DEFINED} AS cron FROM customer WHERE {_DEFINED} <> ''")
def _cron_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.schedules(_definitions(spark, sf_dir)).select("id", "cron")


@query("input_validation", """SELECT event_id, (event_id % 300) <= 255 AND (event_id * 13) % 70000 BETWEEN 1 AND 65535 AS valid FROM events""")
def _input_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).selectExpr("event_id", "concat('10.0.0.', event_id % 300) AS ip", "(event_id * 13) % 70000 AS port")
    return rows.select("event_id", triggers.valid_address(F.col("ip"), F.col("port")).alias("valid"))


# ---------------------------------------------------------------- codecs


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr("user_id AS series", "event_id AS i", "event_id * 3 - (event_id % 10) * 7 AS v")


_DELTA = """d AS (SELECT user_id AS series, event_id AS i, event_id * 3 - (event_id % 10) * 7 AS v,
    event_id * 3 - (event_id % 10) * 7 - coalesce(lag(event_id * 3 - (event_id % 10) * 7) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS d FROM events)"""


@query(
    "delta_encode",
    f"WITH {_DELTA} SELECT series, i, d, greatest(1, CAST(ceil(length(bin(CASE WHEN d >= 0 THEN d * 2 ELSE -d * 2 - 1 END)) / 7.0) AS INTEGER)) AS n_bytes FROM d",
)
def _delta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.delta_encode(_points(spark, sf_dir))


@query("delta_decode", f"WITH {_DELTA} SELECT series, i, v FROM d")
def _delta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.delta_decode(codecs.delta_encode(_points(spark, sf_dir)))


_RUNS = """o AS (SELECT user_id AS series, event_id AS i, event_type AS v,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events),
    r AS (SELECT series, v AS value, min(i) AS start, count(*) AS n FROM o GROUP BY series, v, g)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.run_length_encode(_events(spark, sf_dir).selectExpr("user_id AS series", "event_id AS i", "event_type AS v"))


@query("rle_encode", f"WITH {_RUNS} SELECT series, value, start, n FROM r")
def _rle_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("series", "value", "start", "n")


@query("rle_decode", f"WITH {_RUNS} SELECT series, value, start, CAST(unnest(generate_series(0, n - 1)) AS INTEGER) AS k FROM r")
def _rle_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    return codecs.run_length_decode(runs).join(runs.select("series", "run", "start"), ["series", "run"]).select("series", "value", "start", "k")


@query("top8_values", f"WITH {_RUNS} SELECT value, CAST(sum(n) AS BIGINT) AS freq FROM r GROUP BY value ORDER BY freq DESC, value LIMIT 8")
def _top8_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.top_values(_runs(spark, sf_dir))


@query(
    "ngram_dictionary",
    """WITH g AS (SELECT substr(text, CAST(i AS BIGINT), 4) AS gram FROM (SELECT text, unnest(generate_series(1, length(text) - 3)) AS i FROM documents))
    SELECT gram, count(*) AS freq FROM g GROUP BY gram HAVING count(*) > 2""",
)
def _ngram_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.ngrams(table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "text"), 4)


@query(
    "ngram_spectrum",
    """WITH g AS (SELECT n, substr(name, CAST(i AS BIGINT), CAST(n AS BIGINT)) AS gram FROM (
        SELECT p_name AS name, n, unnest(generate_series(1, length(p_name) - n + 1)) AS i FROM part, generate_series(3, 16) t(n)))
    SELECT CAST(n AS INTEGER) AS n, gram, count(*) AS freq FROM g GROUP BY ALL HAVING count(*) > 2""",
)
def _ngram_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-grams of every dictionary length, 3 to 16, at every place."""
    names = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name AS text")
    each = [codecs.ngrams(names, n).select(F.lit(n).alias("n"), "gram", "freq") for n in range(3, 17)]
    return reduce(DataFrame.union, each)


_HEX = "hex(encode(text))"
_BYTE = "(strpos('0123456789ABCDEF', substr(h, {at}, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, {at} + 1, 1)) - 1"
_FEATURES = f"""b AS (SELECT doc_id, {_HEX} AS h, octet_length(encode(text)) AS size FROM documents),
    places AS (SELECT doc_id, substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS one, CASE WHEN i + 4 <= least(size, 1000) THEN substr(h, CAST(2 * i + 1 AS BIGINT), 8) END AS four
        FROM (SELECT *, unnest(generate_series(0, least(size, 1000) - 1)) AS i FROM b)),
    ones AS (SELECT doc_id, max(n) AS byte_count FROM (SELECT doc_id, count(*) AS n FROM places GROUP BY doc_id, one) GROUP BY 1),
    fours AS (SELECT doc_id, max(n) AS gram_count FROM (SELECT doc_id, count(*) AS n FROM places WHERE four IS NOT NULL GROUP BY doc_id, four) GROUP BY 1),
    items AS (SELECT doc_id, h, unnest(generate_series(0, 12)) AS k FROM b WHERE size >= 104),
    numbers AS (SELECT doc_id, {" + ".join(f"CAST({_BYTE.format(at=f'CAST(16 * k + {2 * j + 1} AS BIGINT)')} AS HUGEINT) * {256**j}::HUGEINT" for j in range(8))} AS v FROM items),
    series AS (SELECT doc_id, bool_and(abs(CASE WHEN v >= {2**63}::HUGEINT THEN v - {2**64}::HUGEINT ELSE v END) <= {10**15}) AS series FROM numbers GROUP BY 1),
    f AS (SELECT doc_id, CAST(size AS BIGINT) AS size, coalesce(series, false) AS series, coalesce(byte_count, 0) AS byte_count, coalesce(gram_count, 0) AS gram_count
        FROM b LEFT JOIN ones USING (doc_id) LEFT JOIN fours USING (doc_id) LEFT JOIN series USING (doc_id)),
    chosen AS (SELECT *, CASE WHEN size < 100 THEN 'none' WHEN size < 1024 THEN 'snappy' WHEN size < 10240 THEN 'lz4' WHEN byte_count > 800 THEN 'rle'
        WHEN series THEN 'delta' WHEN gram_count > 10 THEN 'dictionary' WHEN byte_count > 500 THEN 'rle' ELSE 'zstd' END AS codec FROM f)"""


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.encode("text", "UTF-8").alias("value"))
    shape = codecs.features(blobs)
    return shape.withColumn("codec", codecs.choose(*map(F.col, ("size", "series", "byte_count", "gram_count"))))


@query("kv_codec_auto", f"WITH {_FEATURES} SELECT doc_id, codec FROM chosen")
def _kv_codec_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codec of each blob by its size and content."""
    return _chosen(spark, sf_dir).select(F.col("key").cast("long").alias("doc_id"), "codec")


@query("codec_features", f"WITH {_FEATURES} SELECT CAST(doc_id AS VARCHAR) AS key, size, series, byte_count, gram_count, codec FROM chosen")
def _codec_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(spark, sf_dir).drop("value")


@query(
    "kv_stats",
    f"""WITH b AS (SELECT doc_id, {_HEX} AS h, octet_length(encode(text)) AS size FROM documents),
    places AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS one FROM (SELECT *, unnest(generate_series(0, size - 1)) AS i FROM b)),
    starts AS (SELECT doc_id, i FROM (SELECT *, lag(one) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM places) WHERE p IS NULL OR p <> one),
    runs AS (SELECT doc_id, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), size) - i AS n FROM starts JOIN b USING (doc_id)),
    rle AS (SELECT doc_id, sum(1 + ceil(length(ltrim(bin(n), '0')) / 7.0)) AS packed FROM runs GROUP BY 1),
    m AS (SELECT size AS o, CASE WHEN doc_id % 2 = 0 THEN 4 + coalesce(packed, 0) ELSE size END AS c, CASE WHEN doc_id % 2 = 0 THEN 'rle' ELSE 'none' END AS codec
        FROM b LEFT JOIN rle USING (doc_id))
    SELECT codec, count(*) AS puts, CAST(sum(o) AS BIGINT) AS original, CAST(sum(c) AS BIGINT) AS compressed, round(coalesce(sum(o) / nullif(sum(c), 0), 1.0), 6) AS ratio FROM m GROUP BY codec""",
)
def _kv_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the texts are stored as they are, half as runs: the sizes are those of the encoded blobs."""
    docs = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 2 == 0, "rle").otherwise("none").alias("codec"), F.encode("text", "UTF-8").alias("value"))
    sizes = docs.withColumn("blob", B.encode(F.col("codec"), F.col("value")))
    meta = sizes.select("codec", F.octet_length("value").cast("long").alias("original_size"), F.octet_length("blob").cast("long").alias("compressed_size"))
    return codecs.statistics(meta).withColumn("ratio", F.round("ratio", 6))


@query("codec_matrix")
def _codec_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All codecs over two shapes of the part table: sizes as runs of bytes, names as text."""
    part = table(spark, sf_dir, "part").withColumn("key", (F.col("p_partkey") / 100).cast("long").cast("string"))
    grouped = part.groupBy("key").agg(F.array_join(F.sort_array(F.collect_list("p_name")), ";").alias("names"), F.array_join(F.transform(F.sort_array(F.collect_list("p_size")), lambda x: F.repeat(F.char(x + 32), 20)), "").alias("runs"))
    shapes = grouped.selectExpr("key", "explode(map('text', encode(names, 'UTF-8'), 'runs', encode(runs, 'UTF-8'))) AS (shape, value)")
    return codecs.matrix(shapes)


@query(
    "lru_eviction",
    """WITH r AS (SELECT doc_id AS key, n_chars AS size, sum(n_chars) OVER (ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS newer FROM documents)
    SELECT key, size, CAST(newer AS BIGINT) AS newer, newer > 1000000 AS evicted FROM r""",
)
def _lru_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").selectExpr("doc_id AS key", "n_chars AS size", "doc_id AS at")
    return codecs.eviction(items, 1_000_000).select("key", "size", "newer", "evicted")


# ---------------------------------------------------------------- snapshots, fragments, pacing

_DIFF = """d AS (SELECT user_id AS entity, event_id AS seq, row_number() OVER w = 1 AS full,
      row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w AS c0,
      row_number() OVER w = 1 OR floor(value) IS DISTINCT FROM lag(floor(value)) OVER w AS c1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    e AS (SELECT entity, seq, "full", c0::INTEGER + 2 * c1::INTEGER AS mask, CASE WHEN c1 THEN 2 WHEN c0 THEN 1 ELSE 0 END AS last_changed FROM d)"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _events(spark, sf_dir).selectExpr("user_id AS entity", "event_id AS seq", "event_type", "floor(value) AS v")
    return snapshots.field_delta(states, ["event_type", "v"])


@query("field_delta", f'WITH {_DIFF} SELECT entity, seq, "full", mask, last_changed FROM e')
def _field_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir)


@query(
    "field_frequencies",
    f"WITH {_DIFF} SELECT 'event_type' AS field, count(*) FILTER (mask & 1 <> 0) AS changes FROM e UNION ALL SELECT 'v', count(*) FILTER (mask & 2 <> 0) FROM e",
)
def _field_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.field_frequencies(_diff(spark, sf_dir), ["event_type", "v"])


@query(
    "snapshot_match",
    """WITH a AS (SELECT c_custkey AS k, c_nationkey // 5 AS n FROM customer), b AS (SELECT c_custkey + 20 AS k, c_nationkey // 5 AS n FROM customer)
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS change
    FROM a FULL JOIN b ON a.k = b.k""",
)
def _snapshot_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_nationkey div 5 AS n")
    return snapshots.match_snapshots(rows, rows.withColumn("k", F.col("k") + 20), "k", ["n"])


@query(
    "delta_base",
    """SELECT user_id AS client, event_id AS seq, event_id - event_id % 40 AS acked,
    CASE WHEN event_id - event_id % 40 > 0 AND event_id % 40 < 29 THEN 'delta' ELSE 'full' END AS kind FROM events""",
)
def _delta_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.delta_base(_events(spark, sf_dir).selectExpr("user_id AS client", "event_id AS seq", "event_id - event_id % 40 AS acked"))


_PIECES = """p AS (SELECT doc_id AS id, CAST(unnest(generate_series(0, octet_length(encode(text)) // 1300)) AS INTEGER) AS piece, octet_length(encode(text)) AS total FROM documents),
    f AS (SELECT id, piece, least(1300, total - piece * 1300) AS length FROM p)"""


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.fragments(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.octet_length("text").cast("long").alias("length")))


@query("fragments", f"WITH {_PIECES} SELECT id, piece, CAST(length AS BIGINT) AS length FROM f")
def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


@query(
    "reassembly",
    f"""WITH {_PIECES}, k AS (SELECT * FROM f WHERE (id * 31 + piece * 17) % 23 <> 4)
    SELECT id, CAST(sum(length) AS BIGINT) AS length FROM k GROUP BY id HAVING count(*) = max(piece) + 1 AND arg_max(length, piece) < 1300""",
)
def _reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.reassemble(_pieces(spark, sf_dir).where("(id * 31 + piece * 17) % 23 <> 4"))


@query(
    "unacked_ring",
    """WITH a AS (SELECT user_id AS client, max(event_id) - user_id * 10 AS ack FROM events GROUP BY 1)
    SELECT e.user_id AS client, count(*) AS n_open, min(event_id) AS first_open, max(event_id) AS last_open, count(*) >= 64 AS dropped
    FROM events e JOIN a ON a.client = e.user_id WHERE e.event_id > a.ack GROUP BY 1""",
)
def _unacked_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = _events(spark, sf_dir).selectExpr("user_id AS client", "event_id AS seq")
    clients = commands.groupBy("client").agg((F.max("seq") - F.col("client") * 10).alias("ack"))
    return snapshots.unacknowledged(clients, commands)


@query("redundancy_dedupe", "SELECT user_id AS client, event_id AS seq, event_id AS packet, 3::BIGINT AS times FROM events")
def _redundancy_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.redundant(_events(spark, sf_dir).selectExpr("user_id AS client", "event_id AS seq"))


@query(
    "choke_buckets",
    "SELECT user_id AS client, CAST(floor((epoch_us(ts) // 1000) / 33.0) AS BIGINT) AS slot, count(*) AS n, max((epoch_us(ts) // 1000)) AS last_ms FROM events GROUP BY 1, 2",
)
def _choke_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.choke(_events(spark, sf_dir).selectExpr("user_id AS client", "unix_millis(cast(ts AS timestamp)) AS at_ms"), 30)


@query(
    "rate_shape",
    """WITH RECURSIVE o AS (SELECT user_id AS client, event_id AS seq, (epoch_us(ts) // 1000) AS at_ms, 100 + event_id % 5000 AS bytes,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    s AS (
      SELECT client, seq, i, at_ms AS leaves_ms, at_ms + greatest(bytes * 1000 // 2, 60000) AS free FROM o WHERE i = 1
      UNION ALL
      SELECT o.client, o.seq, o.i, greatest(o.at_ms, s.free), greatest(o.at_ms, s.free) + greatest(o.bytes * 1000 // 2, 60000)
      FROM s JOIN o ON o.client = s.client AND o.i = s.i + 1
    ) SELECT client, seq, leaves_ms FROM s""",
)
def _rate_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    sends = _events(spark, sf_dir).selectExpr("user_id AS client", "event_id AS seq", "unix_millis(cast(ts AS timestamp)) AS at_ms", "100 + event_id % 5000 AS bytes")
    return snapshots.rate_shape(sends, 2, 60_000)


@query("matrix_fill", "SELECT i, array_to_string([i * 7 + j FOR j IN generate_series(0, 6)], ',') AS row FROM generate_series(0, 99) t(i)")
def _matrix_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.matrix_fill(spark, 100, 7).selectExpr("i", "array_join(transform(row, x -> cast(x AS string)), ',') AS row")


# ---------------------------------------------------------------- counters, logins, downloads, tokens


@query(
    "sequence_counters",
    f"""WITH {_AUDIT} SELECT channel, count(*) FILTER (verdict = 'in_order') AS ordered, count(*) FILTER (verdict = 'gap') AS after_gap,
      count(*) FILTER (verdict = 'stale') AS stale, CAST(coalesce(sum(nack_end - nack_start + 1), 0) AS BIGINT) AS dropped FROM audit GROUP BY channel""",
)
def _sequence_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.counters(log.sequence_audit(arrivals(spark, sf_dir)))


@query(
    "heartbeats",
    """WITH s AS (SELECT event_type AS channel, (epoch_us(ts) + 59999999) // 60000000 AS slot, max(event_id + 1) AS seq FROM events GROUP BY 1, 2),
    h AS (SELECT channel, slot, max(seq) OVER w AS newest_seq, coalesce(lead(slot) OVER w - 1, slot) AS last FROM s WINDOW w AS (PARTITION BY channel ORDER BY slot))
    SELECT channel, unnest(generate_series(slot, last)) * 60 AS at_s, newest_seq FROM h""",
)
def _heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.heartbeats(_events(spark, sf_dir).selectExpr("event_type AS channel", "ts", "event_id + 1 AS seq"), 60)


@query(
    "login_tries",
    """WITH c AS (SELECT c_custkey AS subscriber, c_custkey * 37 % 1500 AS ms, c_custkey % 500 AS last_recv FROM customer),
    t AS (SELECT *, (ms + 99) // 100 + 1 AS needed FROM c)
    SELECT subscriber, least(needed, 10) AS tries, needed <= 10 AS connected, CASE WHEN needed <= 10 THEN last_recv + 1 END AS expected_seq FROM t""",
)
def _login_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.login(table(spark, sf_dir, "customer").selectExpr("c_custkey AS subscriber", "c_custkey * 37 % 1500 AS answers_ms", "c_custkey % 500 AS last_recv"))


@query(
    "server_directory",
    """WITH b AS (SELECT user_id AS server, ts, '10.' || user_id % 256 || '.' || event_id % 4 || '.1' AS address FROM events),
    l AS (SELECT server, max(ts) AS last_seen FROM b GROUP BY server)
    SELECT l.server, max(b.address) AS address, l.last_seen FROM l JOIN b ON b.server = l.server AND b.ts = l.last_seen
    WHERE l.last_seen >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 6 HOUR GROUP BY l.server, l.last_seen""",
)
def _server_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = _events(spark, sf_dir).selectExpr("user_id AS server", "concat('10.', user_id % 256, '.', event_id % 4, '.1') AS address", "ts AS at")
    return sessions.directory(beats, F.expr("TIMESTAMP_NTZ '2024-01-30 12:00:00'"), "INTERVAL 6 HOURS")


@query(
    "block_download",
    """WITH c AS (SELECT event_id AS client, event_id % 41 AS acked, least(40, event_id % 41 + user_id % 9) AS sent, 40 AS blocks, event_id * 7919 % 2000 AS silent_ms FROM events),
    w AS (SELECT *, least(blocks, acked + 8) AS tail FROM c), r AS (SELECT *, sent >= tail AND acked < blocks AND silent_ms > 1000 AS rewound FROM w),
    f AS (SELECT *, CASE WHEN rewound THEN acked + 1 WHEN sent < tail THEN sent + 1 END AS from_block FROM r)
    SELECT client, rewound, from_block, CASE WHEN from_block IS NOT NULL THEN tail END AS to_block, acked >= blocks AS done FROM f""",
)
def _block_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.download(_events(spark, sf_dir).selectExpr(
        "event_id AS client", "event_id % 41 AS acked", "least(40, event_id % 41 + user_id % 9) AS sent", "40L AS blocks", "event_id * 7919 % 2000 AS silent_ms"
    ))


@query(
    "message_queue",
    """WITH RECURSIVE o AS (SELECT user_id AS client, event_id AS seq, epoch_us(ts) // 1000 AS at_ms, (event_id * 7919 % 90000) // 1300 + 1 AS pieces,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    s AS (
      SELECT client, seq, i, pieces, at_ms, at_ms AS starts_ms FROM o WHERE i = 1
      UNION ALL
      SELECT o.client, o.seq, o.i, o.pieces, o.at_ms, greatest(o.at_ms, s.starts_ms + s.pieces * 20000) FROM s JOIN o ON o.client = s.client AND o.i = s.i + 1
    ) SELECT client, seq, pieces, starts_ms > at_ms AS queued, starts_ms, starts_ms + pieces * 20000 AS left_ms FROM s""",
)
def _message_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    sends = _events(spark, sf_dir).selectExpr("user_id AS client", "event_id AS seq", "unix_millis(cast(ts AS timestamp)) AS at_ms", "event_id * 7919 % 90000 AS bytes")
    return snapshots.message_queue(sends, 20_000)


@query(
    "token_states",
    """WITH r AS (SELECT event_id AS id, event_id % 5 AS kind, 't' || user_id AS t, 1700000000 + event_id * 7919 % 20000 - 8000 AS expires_at FROM events)
    SELECT id, CASE WHEN kind > 1 THEN t END AS token, CASE WHEN kind <= 1 THEN 'missing' WHEN expires_at < 1700000000 THEN 'expired'
      WHEN expires_at < 1700003600 THEN 'renewed' ELSE 'valid' END AS state FROM r""",
)
def _token_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('Basic t', user_id) WHEN 2 THEN concat(' Bearer  t', user_id, ' ') ELSE concat('Bearer t', user_id) END AS header"
    rows = _events(spark, sf_dir).selectExpr("event_id AS id", header, "1700000000 + event_id * 7919 % 20000 - 8000 AS expires_at")
    return triggers.token_state(rows, F.lit(1_700_000_000))


@query(
    "first_rows",
    "SELECT user_id AS skey, ts, event_id + 1 AS seq, value AS price, event_type AS side FROM events ORDER BY ts, skey, seq LIMIT 1000",
)
def _first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks.first_rows(_ticks(spark, sf_dir), 1000)


@query(
    "byte_order",
    """WITH v AS (SELECT event_id AS id, event_id % 65536 AS h, event_id * 7919 % 4294967296 AS w, event_id AS q FROM events),
    b AS (SELECT id, h % 256 * 256 + h // 256 AS swap16, w % 256 * 16777216 + w // 256 % 256 * 65536 + w // 65536 % 256 * 256 + w // 16777216 AS swap32,
      CAST(q % 256 AS HUGEINT) * 72057594037927936 + q // 256 % 256 * 281474976710656 + q // 65536 % 256 * 1099511627776 + q // 16777216 % 256 * 4294967296 AS u FROM v)
    SELECT id, swap16, swap32, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS swap64 FROM b""",
)
def _byte_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).selectExpr("event_id AS id", "event_id % 65536 AS h", "event_id * 7919 % 4294967296 AS w")
    return rows.select(
        "id", scalar.swap_bytes(F.col("h"), 2).alias("swap16"), scalar.swap_bytes(F.col("w"), 4).alias("swap32"), scalar.swap_bytes(F.col("id"), 8).alias("swap64")
    )


@query(
    "signed_fields",
    """WITH v AS (SELECT event_id AS id, event_id * 7919 % 4096 - 2048 AS v FROM events), f AS (SELECT *, ((v % 1024) + 1024) % 1024 AS m FROM v)
    SELECT id, CASE WHEN m >= 512 THEN m - 1024 ELSE m END AS field, v NOT BETWEEN -512 AND 511 AS overflow FROM f""",
)
def _signed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.signed_fields(_events(spark, sf_dir).selectExpr("event_id AS id", "event_id * 7919 % 4096 - 2048 AS value"), 10)


@query("latest_state", "SELECT user_id AS entity, arg_max(event_type || ':' || event_id, event_id) AS state, max(event_id) AS seq FROM events GROUP BY 1")
def _latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.latest_state(_events(spark, sf_dir).selectExpr("user_id AS entity", "concat(event_type, ':', event_id) AS state", "event_id AS seq"))


# ---------------------------------------------------------------- stores and streams


@query(
    "kv_roundtrip",
    """SELECT 'doc/' || doc_id || '.txt' AS key, 'doc_' || doc_id || '.txt' AS filename, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS version, true AS intact,
      sha256(CASE WHEN doc_id % 7 = 0 THEN 'second ' ELSE '' END || coalesce(text, '')) AS digest FROM documents""",
)
def _kv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents put into a new store, a seventh of them a second time, and read back."""
    store = KeyValueStore(spark, scratch_folder(spark))
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "concat('doc/', doc_id, '.txt') AS key", "coalesce(text, '') AS text")
    store.put(docs.select("key", F.encode("text", "UTF-8").alias("value")), 1)
    again = docs.where("doc_id % 7 = 0").select("key", F.encode(F.concat(F.lit("second "), "text"), "UTF-8").alias("value"))
    store.put(again, 2)
    return store.values().select("key", "intact", F.sha2("value", 256).alias("digest")).join(store.metadata().select("key", "filename", "version"), "key")


@query(
    "streamed_status",
    f"""SELECT CAST(l_orderkey AS VARCHAR) AS execution_id, concat_ws('-', 'task', l_linenumber, l_partkey, l_suppkey) AS task_name,
      max({_STATUS}) AS status, 2::BIGINT AS event_seq FROM lineitem GROUP BY 1, 2""",
)
def _streamed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two events of each task queued as JSON, streamed in, and the last of each kept."""
    folder = scratch_folder(spark)
    last = _tasks(spark, sf_dir).groupBy("execution_id", "task_name").agg(F.max("status").alias("status")).withColumn("event_seq", F.lit(2))
    both = last.union(last.withColumn("status", F.lit("running")).withColumn("event_seq", F.lit(1)))
    workflows.status_events(both).write.text(f"{folder}/queue")
    events = stateful.parse_status(spark.readStream.option("maxFilesPerTrigger", 8).text(f"{folder}/queue"))
    stateful.upsert_status(events, f"{folder}/status", f"{folder}/progress").awaitTermination()
    kept = spark.read.parquet(f"{folder}/status")
    return kept.where(F.col("version") == kept.agg(F.max("version")).first()[0]).drop("version")


@query(
    "streamed_windows",
    """WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 2 HOUR""",
)
def _streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of the events as a stream: the windows that its watermark closed."""
    folder = scratch_folder(spark)
    kind = _events(spark, sf_dir).schema
    stream = spark.readStream.schema(kind).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = stateful.windowed(stream, "1 hour", "2 hours")
    counts.writeStream.format("parquet").option("path", f"{folder}/counts").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{folder}/counts").withColumn("start", F.col("start").cast("timestamp_ntz"))


# ---------------------------------------------------------------- extensions


def _relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr("user_id", "(event_id * 7919) % 150 AS to_user_id").distinct()


_RELATION = "rel AS (SELECT DISTINCT user_id, (event_id * 7919) % 150 AS to_user_id FROM events)"


@query(
    "social_counts",
    f"""WITH {_RELATION}, u AS (SELECT user_id AS id, 1 AS a, 0 AS b FROM rel UNION ALL SELECT to_user_id, 0, 1 FROM rel)
    SELECT id, CAST(sum(a) AS BIGINT) AS follow_count, CAST(sum(b) AS BIGINT) AS follower_count FROM u GROUP BY id""",
)
def _social_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extensions.follow_counts(_relation(spark, sf_dir))


@query("social_mutual", f"WITH {_RELATION} SELECT x.user_id AS a, x.to_user_id AS b FROM rel x JOIN rel y ON x.user_id = y.to_user_id AND x.to_user_id = y.user_id WHERE x.user_id < x.to_user_id")
def _social_mutual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extensions.mutual(_relation(spark, sf_dir))


@query(
    "tumbling_hours",
    "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def _tumbling_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extensions.tumbling(_events(spark, sf_dir), "1 hour", "event_type").withColumn("total", F.round("total", 4))


@query(
    "user_sessions",
    """WITH o AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR, true) AS new FROM events),
    s AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def _user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extensions.sessions(_events(spark, sf_dir), "6 hours", "user_id")


@query(
    "as_of_value",
    """WITH l AS (SELECT * FROM events WHERE event_type = 'click'), r AS (SELECT user_id, ts, value AS v FROM events WHERE event_type = 'view')
    SELECT l.event_id, r.v FROM l ASOF LEFT JOIN r ON r.user_id = l.user_id AND r.ts <= l.ts""",
)
def _as_of_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    right = events.where("event_type = 'view'").selectExpr("user_id", "ts", "value AS v")
    return extensions.as_of(events.where("event_type = 'click'").select("event_id", "user_id", "ts"), right, "user_id", "ts", "v").select("event_id", "v")


@query(
    "line_rollup",
    """SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level, count(*) AS n, round(sum(l_quantity), 2) AS total
    FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
)
def _line_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extensions.roll_up(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity").withColumn("total", F.round("total", 2))
