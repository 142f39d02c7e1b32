"""Literal cases: the log, sessions, graphs, workflows, codecs, fragments, sources and streams."""

import struct
import time
from collections import Counter
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.functions import bytes as B
from tidewright.functions import scalar
from tidewright.operators import codecs, dag, log, workflows, sessions, snapshots, ticks, triggers
from tidewright.sources.kvstore import KeyValueStore
from tidewright.sources.logsource import QUOTE, TickGenerator, definitions
from tidewright.streaming import stateful


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------ log


def test_audit_case(spark):
    arrivals = frame(spark, [("a", s, i) for i, s in enumerate([1, 2, 5, 3, 6, 6, 9])], "channel string, seq long, arrival long")
    out = [(r.verdict, r.nack_start, r.nack_end) for r in log.sequence_audit(arrivals).orderBy("arrival").collect()]
    no = (None, None)
    assert out == [("in_order", *no), ("in_order", *no), ("gap", 3, 4), ("stale", *no), ("in_order", *no), ("stale", *no), ("gap", 7, 8)]


@pytest.mark.parametrize("ranges", [2, 7, 64])
def test_audit_in_ranges(spark, ranges):
    rows = spark.range(900).where("id % 37 <> 5").selectExpr("concat('c', id % 2) AS channel", "id div 2 + 1 AS seq", "id + (id * 7919) % 11 AS arrival")
    assert sorted(map(tuple, log.sequence_audit(rows, ranges).collect()), key=str) == sorted(map(tuple, log.sequence_audit(rows).collect()), key=str)
    assert log.sequence_audit(rows.limit(0), ranges).count() == 0


def test_loss_is_repaired(spark):
    whole = frame(spark, [("a", s) for s in range(1, 21)], "channel string, seq long")
    lossy = frame(spark, [("a", s, s) for s in range(1, 21) if s not in (11, 12, 13)], "channel string, seq long, arrival long")
    out = log.repair(lossy, whole).orderBy("seq").collect()
    assert [r.seq for r in out] == list(range(1, 21)) and [r.seq for r in out if r.repaired] == [11, 12, 13]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.permutations(list(range(1, 16))), st.sets(st.integers(1, 14)))
def test_repair_holds_every_sequence(spark, order, lost):
    kept = [s for s in order if s not in lost]
    arrivals = frame(spark, [("c", s, i) for i, s in enumerate(kept)], "channel string, seq long, arrival long")
    whole = frame(spark, [("c", s) for s in range(1, 16)], "channel string, seq long")
    assert sorted(r.seq for r in log.repair(arrivals, whole).collect()) == list(range(1, 16))


def test_range_and_recovery(spark, tmp_path):
    rows = [(i, 100.0 + i) for i in range(1, 11)]
    frame(spark, rows, "seq long, bid double").write.parquet(str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    out = log.between(stored, 3, 7).collect()
    assert [r.bid for r in out] == [103.0, 104.0, 105.0, 106.0, 107.0]
    assert log.recover(stored).first().current_seq == 10 and log.recover(stored.limit(0)).first().current_seq == 0
    assert log.point(stored, 4).first().bid == 104.0 and log.point(stored, 40).count() == 0
    assert "PushedFilters: [IsNotNull(seq), GreaterThanOrEqual(seq,3)" in stored.where("seq BETWEEN 3 AND 7")._jdf.queryExecution().toString()


def test_late_joiner_and_reconnect(spark):
    whole = frame(spark, [("a", s) for s in range(1, 16)], "channel string, seq long")
    subscribers = frame(spark, [("new", "a", None), ("back", "a", 5), ("done", "a", 15)], "subscriber string, channel string, last_recv long")
    got = {}
    for r in log.resume(whole, subscribers).collect():
        got.setdefault(r.subscriber, []).append(r.seq)
    assert sorted(got["new"]) == list(range(1, 16)) and sorted(got["back"]) == list(range(6, 16)) and "done" not in got


def test_nacks_rewind_and_trigger(spark):
    sessions_ = frame(spark, [("s", 60), ("t", 5)], "subscriber string, next_send long")
    nacks = frame(spark, [("s", n) for n in (50, 51, 52, 53, 54, 55)], "subscriber string, nack_start long")
    acks = frame(spark, [("t", 9), ("t", 2)], "subscriber string, last_recv long")
    out = {r.subscriber: (r.next_send, r.needs_regroup) for r in log.progress(sessions_, acks, nacks).collect()}
    assert out == {"s": (50, True), "t": (10, False)}


# ------------------------------------------------------------ sessions


def groups(spark, positions, threshold):
    rows = [("c", f"s{i:02}", p) for i, p in enumerate(positions)]
    out = sessions.progress_groups(frame(spark, rows, "channel string, subscriber string, next_send long"), threshold).collect()
    by = {}
    for r in out:
        by.setdefault(r.group_id, []).append(r.next_send)
    return sorted(sorted(x) for x in by.values())


def test_progress_groups(spark):
    assert groups(spark, [100, 110, 120, 130, 140, 500], 50) == [[100, 110, 120, 130, 140], [500]]
    assert len(groups(spark, [100 + i % 5 * 10 for i in range(20)], 50)) == 1
    assert sorted(map(len, groups(spark, [7] * 51, 50))) == [1, 50]


def test_time_out(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    beats = frame(spark, [("a", at(9)), ("b", at(11))], "subscriber string, at timestamp_ntz")
    out = {r.subscriber: r.active for r in sessions.heartbeat_timeout(beats, F.lit(at(40)).cast("timestamp_ntz")).collect()}
    assert out == {"a": False, "b": True}


def test_subnets_and_priorities(spark):
    rows = [("c", "a", "10.1.2.3", 2), ("c", "b", "10.1.2.9", 1), ("c", "d", "10.9.2.9", 0)]
    members = frame(spark, rows, "channel string, subscriber string, ip string, priority int")
    (one,) = sessions.subnet_groups(members).collect()
    assert (one.subnet, one.subscribers, one.multicast) == ("10.1.2", "a,b", "239.10.1.2")
    assert {r.subscriber: r.group_id for r in sessions.priority_groups(members).collect()} == {"a": "vip_a", "b": "high_priority", "d": None}


# ------------------------------------------------------------ streams of ticks


def tick_rows(spark):
    rows = [(k, datetime(2024, 1, 1, 0, 0, i), k * 100 + i) for k in (1001, 1002, 1003) for i in range(20)]
    return frame(spark, rows, "skey int, ts timestamp_ntz, seq long")


def test_reader(spark):
    reader = ticks.OrderReader(tick_rows(spark), [1001, 1002])
    first = [reader.next_order() for _ in range(10)]
    reader.reset()
    assert [reader.next_order() for _ in range(10)] == first and {r.skey for r in first} == {1001, 1002}
    rest = []
    while (r := reader.next_order()) is not None:
        rest.append(r)
    times = [r.ts for r in first + rest]
    assert len(times) == 40 and times == sorted(times)
    assert ticks.OrderReader(tick_rows(spark), []).next_order() is None
    assert ticks.listing(tick_rows(spark), "mdl/mbd/order/20240101/").count() == 3


# ------------------------------------------------------------ graphs and workflows

DAG = "dag string, task string, depends_on array<string>"


def test_levels(spark):
    rows = [("chain", f"t{i}", [f"t{i - 1}"] if i else []) for i in range(4)]
    rows += [("diamond", "t1", []), ("diamond", "t2", ["t1"]), ("diamond", "t3", ["t1"]), ("diamond", "t4", ["t2", "t3"])]
    out = {(r.dag, r.task): r.level for r in dag.levels(frame(spark, rows, DAG)).collect()}
    assert [out["chain", f"t{i}"] for i in range(4)] == [0, 1, 2, 3] and [out["diamond", f"t{i}"] for i in range(1, 5)] == [0, 1, 1, 2]


def test_problems(spark):
    rows = [("dup", "a", []), ("dup", "a", []), ("lost", "a", ["zz"]), ("loop", "a", ["b"]), ("loop", "b", ["a"]), ("ok", "a", [])]
    assert sorted(tuple(r) for r in dag.problems(frame(spark, rows, DAG)).collect()) == [
        ("dup", "duplicate", "a"), ("loop", "cycle", "a"), ("loop", "cycle", "b"), ("lost", "unknown_parent", "zz"),
    ]


def test_fail_fast(spark):
    rows = [("d", "task1", 0, "success"), ("d", "task2", 1, "failed"), ("d", "task3", 2, "success")]
    out = {r.task: r.status for r in dag.fail_fast(frame(spark, rows, "dag string, task string, level int, outcome string")).collect()}
    assert out == {"task1": "success", "task2": "failed", "task3": "skipped"}
    status = frame(spark, [("e", s) for s in out.values()], "execution_id string, status string")
    assert workflows.roll_up(status).first().status == "failed"


def test_history(spark):
    now = datetime(2024, 6, 1)
    rows = [(123, "running", datetime(2024, 5, 1)), (456, "success", datetime(2024, 5, 20)), (789, "failed", datetime(2024, 2, 20))]
    executions = frame(spark, rows, "id long, status string, created_at timestamp_ntz").withColumn("updated_at", F.col("created_at"))
    out = workflows.times(workflows.history(executions, F.lit(now).cast("timestamp_ntz"))).collect()
    assert [r.id for r in out] == [123, 456] and [r.end_time for r in out] == [None, "2024-05-20 00:00:00"]


def test_definitions(spark):
    text = """{"name": "x", "tasks": [{"name": "a", "command": "true", "result_check": "ok"}, {"name": "b", "command": "exit 1", "depends_on": ["a"]}],
               "triggers": [{"webhook": "/hooks/x"}, {"cron": "* * * * *"}, {"cron": "1 * * * *"}]}"""
    one = definitions(spark, [text, '{"name": "y"}'])
    tasks = one.select(F.col("name").alias("dag"), F.explode("tasks").alias("t")).select("dag", F.col("t.name").alias("task"), "t.depends_on")
    assert {r.task: r.level for r in dag.levels(tasks).collect()} == {"a": 0, "b": 1}
    assert [(r.name, r.cron) for r in triggers.schedules(one).collect()] == [("x", "* * * * *")]
    assert [r.name for r in triggers.matching(one, F.lit("/hooks/x")).collect()] == ["x"]


def test_webhook(spark):
    payload = '{"name":"example"}'
    rows = frame(spark, [(700, 1), (699, 1), (1001, 1), (1000, 2)], "sent_at long, k int").withColumn("payload", F.lit(payload))
    sig = F.when(F.col("k") == 1, triggers.signature(F.col("sent_at"), F.col("payload"), F.lit("s3"))).otherwise("bad")
    out = triggers.verify(rows.withColumn("sig", sig), F.lit(1000), F.lit("s3")).collect()
    assert [r.accepted for r in out] == [True, False, False, False]
    header = frame(spark, [("Bearer abc",), ("abc",), (None,)], "h string").select(triggers.bearer_token(F.col("h")).alias("t")).collect()
    assert [r.t for r in header] == ["abc", None, None]


def test_upsert_and_envelope(spark):
    now = frame(spark, [(1, "a", 0), (2, "b", 0)], "id long, status string, version int")
    more = frame(spark, [(2, "c", 1), (3, "d", 1)], "id long, status string, version int")
    assert sorted((r.id, r.status) for r in workflows.upsert(now, more, ["id"], "version").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r.id for r in workflows.insert_absent(now, more, ["id"]).collect()] == [3]
    assert workflows.envelope(now.limit(1)).first().response == '{"code":0,"message":"success","data":{"id":1,"status":"a","version":0}}'


# ------------------------------------------------------------ codecs


@pytest.mark.parametrize("name", sorted(B.CODECS))
@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=300), st.binary(min_size=1, max_size=8).map(lambda b: b * 40), st.lists(st.integers(-(2**63), 2**63 - 1), max_size=30).map(lambda v: struct.pack(f"<{len(v)}q", *v))))
def test_round_trip(name, data):
    encode, decode = B.CODECS[name]
    assert decode(encode(data)) == data


@given(st.lists(st.integers(0, 2**64 - 1)))
def test_varint(values):
    assert B.unvarint(B.varint(np.array(values, np.uint64))).tolist() == values
    signed = np.array(values, np.uint64).view(np.int64)
    assert (B.unzigzag(B.zigzag(signed)) == signed).all()


def test_known_values():
    assert B.crc32c(b"123456789") == 0xE3069283 and B.crc32c(b"") == 0
    for n in (B.LONG - 1, B.LONG, B.LONG + 77, 100_003, 1_000_001):
        noise = np.random.default_rng(n).bytes(n)
        assert B.crc32c(noise) == B._crc_plain(noise)
    walk = np.cumsum(np.random.default_rng(42).integers(-100, 101, 1000)) + 1_000_000
    raw = walk.astype("<i8").tobytes()
    assert len(raw) / len(B.delta_encode(raw)) > 1.5
    pattern = b"ABCDEFGHIJKLMNOP" * 625
    assert len(pattern) / len(B.dictionary_encode(pattern)) > 2
    sparse = np.zeros(10_000, np.uint8)
    sparse[::50] = 7
    assert len(sparse) / len(B.rle_encode(sparse.tobytes())) > 3


def test_series_queries(spark):
    points = frame(spark, [("s", i, v) for i, v in enumerate([1000, 1005, 1003, 1008, 1006])], "series string, i long, v long")
    steps = codecs.delta_encode(points)
    assert [r.d for r in steps.orderBy("i").collect()] == [1000, 5, -2, 5, -2]
    assert [r.v for r in codecs.delta_decode(steps).orderBy("i").collect()] == [1000, 1005, 1003, 1008, 1006]
    flags = frame(spark, [("s", i, v) for i, v in enumerate([0, 0, 0, 0, 1, 0, 0, 0, 0, 2, 0, 0, 0, 0])], "series string, i long, v long")
    runs = codecs.run_length_encode(flags)
    assert [(r.value, r.n) for r in runs.orderBy("run").collect()] == [(0, 4), (1, 1), (0, 4), (2, 1), (0, 4)]
    assert codecs.run_length_decode(runs).count() == 14


def test_eviction(spark):
    items = frame(spark, [(f"key_{i}", 1 << 20, i) for i in range(12)], "key string, size long, at long")
    for shards in (1, 4, 256):
        out = {r.key: r.evicted for r in codecs.eviction(items, 10 << 20, shards).collect()}
        assert [k for k, gone in out.items() if gone] and {k for k, gone in out.items() if gone} == {"key_0", "key_1"}
    assert codecs.eviction(items.limit(0), 5).count() == 0


def test_store(spark, tmp_path):
    rng = np.random.default_rng(42)
    walk = (np.cumsum(rng.integers(-100, 101, 10_000)) + 1_000_000).astype("<i8").tobytes()
    zeros = np.zeros(20_000, np.uint8)
    values = {"small": b"small data", "random": rng.bytes(5000), "noise": rng.bytes(100_000), "a/series": walk, "a/zeros": zeros.tobytes(), "a/text": b"Lorem ipsum dolor sit amet. " * 900}
    store = KeyValueStore(spark, str(tmp_path / "kv"))
    store.put(frame(spark, [(k, bytearray(v)) for k, v in values.items()], "key string, value binary"), 1)
    store.put(frame(spark, [("small", bytearray(b"newer"))], "key string, value binary"), 2, "gzip")
    again = KeyValueStore(spark, str(tmp_path / "kv"))
    got = {r.key: (bytes(r.value), r.intact) for r in again.get(*values, "missing").collect()}
    assert got == {k: (b"newer" if k == "small" else v, True) for k, v in values.items()}
    meta = {r.key: (r.codec, r.filename) for r in again.metadata().collect()}
    assert {k: c for k, (c, _) in meta.items()} == {"small": "gzip", "random": "lz4", "noise": "zstd", "a/series": "delta", "a/zeros": "rle", "a/text": "dictionary"}
    assert meta["a/zeros"][1] == "a_zeros" and {r.key for r in again.list_keys("a/").collect()} == {"a/series", "a/zeros", "a/text"}
    assert again.statistics().agg(F.sum("puts")).first()[0] == 6


# ------------------------------------------------------------ snapshots


@pytest.mark.parametrize(("length", "pieces"), [(0, [0]), (1299, [1299]), (1300, [1300, 0]), (1301, [1300, 1]), (2600, [1300, 1300, 0])])
def test_fragments(spark, length, pieces):
    out = snapshots.fragments(frame(spark, [(1, length)], "id long, length long"))
    assert [r.length for r in out.orderBy("piece").collect()] == pieces
    assert [r.length for r in snapshots.reassemble(out.union(out)).collect()] == [length]
    assert len(pieces) == 1 or snapshots.reassemble(out.where("piece > 0")).count() == 0


def test_snapshot_rules(spark):
    sends = frame(spark, [(1, 128, 100), (1, 129, 100), (1, 5, None)], "client int, seq long, acked long")
    assert [r.kind for r in snapshots.delta_base(sends).orderBy("seq").collect()] == ["full", "delta", "full"]
    commands = frame(spark, [(c, s) for c, n in ((1, 63), (2, 64)) for s in range(1, n + 1)], "client int, seq long")
    out = snapshots.unacknowledged(frame(spark, [(1, 0), (2, 0)], "client int, ack long"), commands)
    assert {r.client: r.dropped for r in out.collect()} == {1: False, 2: True}
    bits = spark.range(1).select(snapshots.sign_extend(F.lit(0xFFFB), 16).alias("x")).first().x
    assert bits == -5


# ------------------------------------------------------------ sources and streaming


def test_generator_prunes(spark):
    spark.dataSource.register(TickGenerator)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("tidewright_ticks").option("rows", 1000).load()
    assert rows.count() == 1000 and [r.seq for r in rows.where("seq BETWEEN 3 AND 7").orderBy("seq").collect()] == [3, 4, 5, 6, 7]
    assert rows.where("seq = 9 AND side = 'B'").count() == 1 and rows.where("seq > 2000").count() == 0
    assert spark.createDataFrame([], QUOTE).select("header.sequence").dtypes == [("sequence", "bigint")]


def read_stream(spark, rows, path, parts, schema):
    for k in range(parts):
        rows.where(f"arrival % 1000000 >= {k * 60} AND arrival < {(k + 1) * 60}").coalesce(1).write.parquet(f"{path}/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_stream_audit_equals_batch(spark, tmp_path):
    rows = spark.range(240).where("id % 37 <> 5").selectExpr("concat('c', id % 2) AS channel", "id div 2 + 1 AS seq", "id + (id * 7919) % 11 AS arrival")
    stream = read_stream(spark, rows, str(tmp_path / "in"), 5, rows.schema)
    out = stateful.sequence_audit(stream).writeStream.format("memory").queryName("audit").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination()
    batch = log.sequence_audit(rows)
    assert sorted(map(str, spark.table("audit").select(batch.columns).collect())) == sorted(map(str, batch.collect()))


def test_publish_and_status(spark, tmp_path):
    rows = spark.range(200).selectExpr("id AS arrival", "to_json(struct(cast(id % 3 AS string) AS execution_id, 'a' AS task_name, concat('s', id) AS status, id AS event_seq)) AS value")
    stream = read_stream(spark, rows, str(tmp_path / "in"), 4, rows.schema)
    seen = []
    stateful.publish(stream, str(tmp_path / "log"), str(tmp_path / "c1"), lambda b, n: seen.append(n)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 200 and len(seen) == 4
    stateful.upsert_status(stateful.parse_status(stream), str(tmp_path / "status"), str(tmp_path / "c2")).awaitTermination()
    last = spark.read.parquet(str(tmp_path / "status" / "version=3")).collect()
    assert sorted((r.execution_id, r.status) for r in last) == [("0", "s198"), ("1", "s199"), ("2", "s197")]


def test_windows_and_spells(spark, tmp_path):
    rows = spark.range(100).selectExpr("id AS arrival", "timestamp_seconds(1700000000 + id * 10 + (id div 50) * 600) AS ts", "'a' AS subscriber", "'x' AS event_type", "'c' AS channel", "id div 2 AS seq")
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def run(df, name):
        df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert len(run(stateful.distinct_messages(stream()), "distinct_rows")) == 50
    assert [r.beats for r in run(stateful.silent_spells(stream()), "spells")] == [50]
    assert sum(r.n for r in run(stateful.windowed(stream(), "1 minute", "1 minute"), "windows")) <= 100


# ------------------------------------------------------------ logins, downloads, queues, tokens


@pytest.mark.parametrize(("value", "width", "swapped"), [(0x1EEF, 4, 0xEF1E0000), (0xFF, 2, 0xFF00), (0x80, 8, -(2**63)), (-1, 8, -1), (0, 4, 0)])
def test_swapped_bytes(spark, value, width, swapped):
    assert spark.range(1).select(scalar.swap_bytes(F.lit(value).cast("long"), width)).first()[0] == swapped


def test_login_tries(spark):
    rows = frame(spark, [("now", 7, 0), ("late", None, 250), ("last", 0, 900), ("over", 3, 901), ("never", 3, None)], "subscriber string, last_recv long, answers_ms long")
    assert [tuple(r)[1:] for r in sessions.login(rows).collect()] == [(1, True, 8), (4, True, 1), (10, True, 1), (10, False, None), (10, False, None)]


def test_block_download(spark):
    rows = [("fresh", 0, 0, 20, 0), ("waits", 4, 12, 20, 1000), ("rewinds", 4, 12, 20, 1001), ("tail", 18, 20, 20, 5000), ("done", 20, 20, 20, 9000)]
    out = sessions.download(frame(spark, rows, "client string, acked long, sent long, blocks long, silent_ms long"))
    assert [tuple(r)[1:] for r in out.collect()] == [(False, 1, 8, False), (False, None, None, False), (True, 5, 12, False), (True, 19, 20, False), (False, None, None, True)]


def test_messages_do_not_mix(spark):
    rows = frame(spark, [("c", 1, 0, 2600), ("c", 2, 10, 5), ("c", 3, 500, 1300)], "client string, seq long, at_ms long, bytes long")
    out = snapshots.message_queue(rows, 50).orderBy("seq").collect()
    assert [(r.pieces, r.queued, r.starts_ms, r.left_ms) for r in out] == [(3, False, 0, 150), (1, True, 150, 200), (2, False, 500, 600)]


def test_token_states(spark):
    rows = [(0, None, 9000), (1, "Basic x", 9000), (2, "Bearer x", 99), (3, " Bearer  x ", 100), (4, "Bearer x", 3700), (5, "Bearer x", None)]
    out = triggers.token_state(frame(spark, rows, "id long, header string, expires_at long"), F.lit(100)).collect()
    assert [r.state for r in out] == ["missing", "missing", "expired", "renewed", "valid", "expired"]


def test_heartbeats_between_messages(spark):
    rows = spark.sql("SELECT 'a' AS channel, timestamp_micros(t * 1000000) AS ts, s AS seq FROM VALUES (1, 5), (4, 9), (5, 7), (22, 12) AS v(t, s)")
    assert sorted(map(tuple, log.heartbeats(rows).collect())) == [("a", 5, 9), ("a", 10, 9), ("a", 15, 9), ("a", 20, 9), ("a", 25, 12)]


@pytest.mark.parametrize("n", [1, 4, 9, 16])
@pytest.mark.parametrize("run", [5, 2 << 20])
def test_ngrams_by_plain_counts(monkeypatch, n, run):
    """Grams across runs, of any width of character, of sliced batches; none across texts."""
    monkeypatch.setattr(codecs, "GRAM_BYTES", run)
    rng = np.random.default_rng(n)
    letters = "ab\0é漢𝄞" + "".join(map(chr, range(0x4E00, 0x4F00)))
    texts = ["".join(letters[i] for i in rng.integers(0, m, k)) for m, k in ((2, 90), (6, 50), (6, 0), (1, n), (3, 3), (len(letters), 120), (4, n - 1), (6, 40))]
    held = pa.array(["skipped", *texts[:4], None, *texts[4:]])[1:].drop_null()
    out = Counter()
    for grams, counts in codecs._count_grams(held, n):
        grams.validate(full=True)
        out.update(dict(zip(grams.to_pylist(), counts.to_pylist(), strict=True)))
    assert out == Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    assert not list(codecs._count_grams(pa.array([], pa.string()), n)) and not list(codecs._count_grams(pa.array(["", ""]), n))


def test_ngrams_of_a_long_text(spark):
    """A text of half a million characters takes seconds, not the square of its length."""
    whole = "abcdefgh" * 65_536
    out = codecs.ngrams(frame(spark, [(1, whole), (2, None), (3, "abc"), (4, "")], "id long, text string"), 4)
    started = time.monotonic()
    assert {r.gram: r.freq for r in out.collect()} == Counter(whole[i : i + 4] for i in range(len(whole) - 3))
    assert time.monotonic() - started < 60
