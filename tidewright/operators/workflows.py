"""Versioned workflow definitions and execution history as DataFrames.

"Now" is always a parameter, so results can be reproduced. Deleted rows are those with a deletion stamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINISHED = ("success", "failed")
NOT_STARTED = ("skipped", "pending")
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
#: Codes and messages of the response envelope (fixed values).
ERRORS = {
    0: "success",
    10001: "service error",
    10002: "request invalid",
    10003: "token invalid",
    10004: "password error",
    10005: "user not exists",
    10006: "yaml invalid",
    10007: "pipeline not exists",
    10008: "pipeline already exists",
    10009: "pipeline starts fail",
    10010: "schedule invalid",
    10011: "get history fail",
    10012: "get history detail fail",
    10013: "webhook invalid",
}
#: Columns of the history report and their widths (fixed values).
REPORT_FORMAT = "%-5d %-15d %-15s %-15s %-20s %-20s"


def live(rows: DataFrame) -> DataFrame:
    """Rows without a deletion stamp."""
    return rows.where("deleted_at IS NULL")


def one(rows: DataFrame, **equal) -> DataFrame:
    """The row of least id with these column values, if any."""
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    return rows.orderBy("id").limit(1)


def history(executions: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Executions of the last ``days``, running ones first, then the latest."""
    recent = executions.where(F.col("created_at") > now - F.expr(f"INTERVAL {days} DAYS"))
    return recent.orderBy(F.when(F.col("status") == "running", 0).otherwise(1), F.desc("created_at"), "id")


def with_workflow(executions: DataFrame, versions: DataFrame) -> DataFrame:
    """Executions with the workflow of their version, 0 where the version is unknown."""
    known = versions.select(F.col("id").alias("version_id"), "workflow_id")
    joined = executions.join(known, executions["workflow_version_id"] == known["version_id"], "left").drop("version_id")
    return joined.withColumn("workflow_id", F.coalesce("workflow_id", F.lit(0)))


def times(rows: DataFrame) -> DataFrame:
    """``start_time`` unless skipped or pending, ``end_time`` once finished, as text."""
    start = F.when(~F.col("status").isin(*NOT_STARTED), F.date_format("created_at", TIME_FORMAT))
    end = F.when(F.col("status").isin(*FINISHED), F.date_format("updated_at", TIME_FORMAT))
    return rows.withColumn("start_time", start).withColumn("end_time", end)


def latest_versions(workflows: DataFrame, versions: DataFrame) -> DataFrame:
    """Each workflow with its latest version's row, in one join on (id, latest_version)."""
    own = versions.select("workflow_id", F.col("version").alias("latest_version"), F.col("id").alias("version_id"), "config")
    return workflows.withColumnRenamed("id", "workflow_id").join(own, ["workflow_id", "latest_version"])


def version_numbers(versions: DataFrame, *order: str) -> DataFrame:
    """Number each workflow's versions from 0 in the given total order."""
    number = F.row_number().over(Window.partitionBy("workflow_id").orderBy(*order)) - 1
    return versions.withColumn("version", number)


def detail(executions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each execution with its tasks, as a count and one text of name and status in order of name."""
    listed = tasks.groupBy("execution_id").agg(
        F.count("*").alias("n_tasks"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("task_name", "status"))), lambda t: F.concat_ws(":", t["task_name"], t["status"])), ",").alias("tasks"),
    )
    joined = executions.join(listed, executions["id"] == listed["execution_id"], "left").drop("execution_id")
    return joined.withColumn("n_tasks", F.coalesce("n_tasks", F.lit(0))).withColumn("tasks", F.coalesce("tasks", F.lit("")))


def upsert(current: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """``current`` with each change inserted or put over its key's row; the greatest ``order`` of a key wins."""
    both = current.unionByName(changes)
    rest = [c for c in current.columns if c not in key]
    last = both.groupBy(*key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("last"))
    return last.select(*key, *[F.col(f"last.{c}").alias(c) for c in rest])


def insert_absent(current: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key is not there yet."""
    return rows.join(current, key, "left_anti")


def roll_up(tasks: DataFrame) -> DataFrame:
    """An execution fails with any of its tasks."""
    failed = F.bool_or(F.col("status") == "failed")
    return tasks.groupBy("execution_id").agg(F.when(failed, "failed").otherwise("success").alias("status"), F.count("*").alias("n_tasks"))


def latest_status(events: DataFrame) -> DataFrame:
    """Each (execution_id, task_name)'s last status by event number."""
    return events.groupBy("execution_id", "task_name").agg(F.max_by("status", "event_seq").alias("status"), F.max("event_seq").alias("event_seq"))


def envelope(rows: DataFrame, code: int = 0) -> DataFrame:
    """Each row as a JSON response of code, message and data; an error has no data."""
    data = F.struct(*rows.columns).alias("data")
    parts = [F.lit(code).alias("code"), F.lit(ERRORS[code]).alias("message"), *([data] if code == 0 else [])]
    return rows.select(F.to_json(F.struct(*parts)).alias("response"))


def report(rows: DataFrame) -> DataFrame:
    """History rows as lines of fixed width."""
    text = [F.coalesce(c, F.lit("")) for c in ("status", "trigger_type", "start_time", "end_time")]
    return rows.select(F.format_string(REPORT_FORMAT, "id", "workflow_id", *text).alias("line"))


def brief(workflows: DataFrame) -> DataFrame:
    """Workflows as listed: id, name, description and latest version."""
    return workflows.select("id", "name", "description", "latest_version")


def status_events(updates: DataFrame) -> DataFrame:
    """Updates as the JSON texts (``value``) in which they are queued: one object of all columns; nulls are left out."""
    return updates.select(F.to_json(F.struct(*updates.columns)).alias("value"))
