"""Plans: filters reach the scan, columns are pruned, and no nested-loop join or needless exchange appears."""

import pytest
from pyspark.sql import functions as F

from tidewright.operators import dag, log, sessions
from tidewright.plans.catalog import REGISTRY


def plan(spark, sf_dir, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return REGISTRY.queries[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", sorted(set(REGISTRY.queries) - {"matrix_fill"}))
def test_no_nested_loops(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize(
    ("name", "parts"),
    [
        ("log_range", ["GreaterThanOrEqual", "LessThanOrEqual"]),
        ("stream_counts", ["ReadSchema: struct<user_id:bigint>"]),
        ("soft_delete", ["ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string"]),
        ("status_rollup", ["partial_"]),
    ],
)
def test_scans(spark, sf_dir, name, parts):
    text = plan(spark, sf_dir, name)
    assert all(p in text for p in parts), text


@pytest.mark.parametrize(("name", "most"), [("sequence_audit", 1), ("tick_positions", 1), ("stream_counts", 1), ("rle_encode", 1), ("delta_decode", 1), ("nack_ranges", 1), ("progress_groups", 2)])
def test_exchanges(spark, sf_dir, name, most):
    assert plan(spark, sf_dir, name).count("Exchange hashpartitioning") <= most


def test_audit_of_many_arrivals_goes_by_ranges(spark, monkeypatch):
    """No task judges a whole channel, and the judgements are those of one task a channel."""
    monkeypatch.setattr(log, "RANGE_ROWS", 200)
    rows = spark.range(3000).selectExpr("concat('c', id % 3 % 2) AS channel", "id + 1 AS seq", "id + (id * 7919) % 11 AS arrival").where("seq % 37 <> 5")
    wide = log.sequence_audit(rows)
    assert "__range" in wide._jdf.queryExecution().analyzed().toString()
    tasks = wide.select("channel", F.col("arrival"))._jdf.queryExecution().executedPlan().toString()
    assert "__range" in tasks
    one = log.sequence_audit(rows, 1)
    assert sorted(wide.collect()) == sorted(one.collect())


def test_folds_hold_no_channel(spark, sf_dir):
    """Grouping by progress and shaping of sends collect no list of a channel's rows."""
    for name in ("progress_groups", "rate_shape"):
        assert "collect_list" not in plan(spark, sf_dir, name)


@pytest.mark.parametrize("batch", ["1", "7", "10000"])
def test_streamed_folds(spark, batch):
    """Batches cut groups and graphs anywhere."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = [(c, f"s{i:03}", i * (7 if c == "a" else 1)) for c in ("a", "b", None) for i in range(60)]
        out = sessions.progress_groups(spark.createDataFrame(rows, "channel string, subscriber string, next_send long"), 20, 50).collect()
        by = {(r.channel, r.subscriber): r.group_id for r in out}
        assert len(by) == 180 and all(by["a", f"s{i:03}"] == f"progress_{i // 3}" for i in range(60))
        assert all(by[c, f"s{i:03}"] == f"progress_{i // 21}" for c in ("b", None) for i in range(60))
        tasks = [(d, f"t{i}", [f"t{i - 1}"] if i else []) for d in (1, 2, None) for i in range(25)]
        out = dag.levels(spark.createDataFrame(tasks, "dag long, task string, depends_on array<string>")).collect()
        assert sorted((str(r.dag), int(r.task[1:]), r.level) for r in out) == sorted((str(d), i, i) for d in (1, 2, None) for i in range(25))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
