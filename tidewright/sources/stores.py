"""Stores on Parquet: a sequenced event log, and versioned workflows with their executions."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import log, workflows

#: Sequences of one directory of a log, by which range scans are pruned.
SEGMENT = 1_000_000


class EventLog:
    """A gap-free sequenced log: ``publish`` appends, ``read`` scans ranges, ``subscribe`` resumes after an offset."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path = spark, path
        self.schema = f"seq long, {schema}, segment long"

    def rows(self) -> DataFrame:
        """The whole log; none before the first publish."""
        files, place = self._files(self.path)
        if not files.exists(place):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _files(self, path: str) -> tuple:
        """The file system of a path, and the path as it takes it."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def current(self) -> int:
        """The last sequence, 0 for an empty log."""
        return log.recover(self.rows()).first().current_seq

    def publish(self, messages: DataFrame, *order: str) -> int:
        """Append messages in the given total order and return the last sequence.

        Messages are sorted over partitions, so no task sees them all, and written once beside the log with the partition
        and place that the writing task saw. What was written is then counted and numbered, so the numbers do not depend
        on a second run dealing rows as the first did. A log has one writer at a time.
        """
        last = self.current()
        sorted_ = messages.repartitionByRange(*order).sortWithinPartitions(*order)
        placed = sorted_.withColumn("__p", F.spark_partition_id())
        placed = placed.withColumn("__i", F.monotonically_increasing_id() - F.shiftleft(F.col("__p").cast("long"), 33))
        draft = f"{self.path.rstrip('/')}.draft-{uuid4().hex}"
        try:
            placed.write.parquet(draft)
            placed = self.spark.read.schema(placed.schema).parquet(draft)
            counts = {r["__p"]: r["n"] for r in placed.groupBy("__p").agg(F.count("*").alias("n")).collect()}
            offset, before = [], last
            for p in sorted(counts):
                offset.append((p, before))
                before += counts[p]
            if offset:
                starts = F.broadcast(self.spark.createDataFrame(offset, "__p int, __before long"))
                numbered = placed.join(starts, "__p").withColumn("seq", F.col("__before") + F.col("__i") + 1)
                out = numbered.withColumn("segment", F.floor(F.col("seq") / SEGMENT)).drop("__p", "__i", "__before")
                out.write.mode("append").partitionBy("segment").parquet(self.path)
        finally:
            self._files(draft)[0].delete(self._files(draft)[1], True)
        return before

    def read(self, start: int, end: int) -> DataFrame:
        """Rows of an inclusive range in order; other segments are not opened."""
        rows = self.rows().where(F.col("segment").between(start // SEGMENT, end // SEGMENT))
        return log.between(rows, start, end).drop("segment")

    def subscribe(self, last_recv: int = 0) -> DataFrame:
        """Rows after an offset, in order; from the first for a new subscriber."""
        return self.rows().where((F.col("segment") >= last_recv // SEGMENT) & (F.col("seq") > last_recv)).orderBy("seq").drop("segment")


class WorkflowStore:
    """Workflows by name with numbered versions, and executions whose newest row counts. All tables only grow."""

    VERSION = "workflow_id long, name string, description string, version int, config string, created_at timestamp"
    EXECUTION = "id string, workflow_id long, version int, trigger_type string, status string, created_at timestamp, updated_at timestamp, event_seq long"
    TASK = "execution_id string, task_name string, status string, stdout string, stderr string, event_seq long"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _table(self, name: str, schema: str) -> DataFrame:
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _append(self, name: str, schema: str, *rows: tuple) -> None:
        self.spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def versions(self) -> DataFrame:
        return self._table("version", self.VERSION)

    def latest(self) -> DataFrame:
        """Each workflow's latest version."""
        rest = [c for c in self.versions().columns if c not in ("workflow_id", "version")]
        last = self.versions().groupBy("workflow_id").agg(F.max("version").alias("version"), F.max_by(F.struct(*rest), "version").alias("r"))
        return last.select("workflow_id", "version", "r.*")

    def create(self, name: str, description: str, config: str, now) -> int:
        """Add a workflow with version 0; a name that is there is an error."""
        if not self.versions().where(F.col("name") == name).isEmpty():
            raise ValueError(f"workflow {name} exists")
        number = (self.versions().agg(F.max("workflow_id")).first()[0] or 0) + 1
        self._append("version", self.VERSION, (number, name, description, 0, config, now))
        return number

    def update(self, workflow_id: int, config: str, now) -> int:
        """Add the next version of a workflow; an unknown one is an error."""
        last = self.latest().where(F.col("workflow_id") == workflow_id).first()
        if last is None:
            raise KeyError(workflow_id)
        self._append("version", self.VERSION, (workflow_id, last["name"], last["description"], last["version"] + 1, config, now))
        return last["version"] + 1

    def trigger(self, workflow_id: int, kind: str, execution_id: str, now) -> None:
        """Record a running execution of the latest version."""
        last = self.latest().where(F.col("workflow_id") == workflow_id).first()
        if last is None:
            raise KeyError(workflow_id)
        self._append("execution", self.EXECUTION, (execution_id, workflow_id, last["version"], kind, "running", now, now, 0))

    def set_status(self, execution_id: str, status: str, event_seq: int, now) -> None:
        """Put an execution's status, keeping what else is known of it."""
        known = self.executions().where(F.col("id") == execution_id).first()
        if known is None:
            raise KeyError(execution_id)
        self._append("execution", self.EXECUTION, (execution_id, known["workflow_id"], known["version"], known["trigger_type"], status, known["created_at"], now, event_seq))

    def set_task(self, execution_id: str, task: str, status: str, event_seq: int, stdout: str = "", stderr: str = "") -> None:
        self._append("task", self.TASK, (execution_id, task, status, stdout, stderr, event_seq))

    def executions(self) -> DataFrame:
        rows = self._table("execution", self.EXECUTION)
        return workflows.upsert(rows, rows.limit(0), ["id"], "event_seq")

    def history(self, now) -> DataFrame:
        """Executions of the last 90 days with start and end, running ones first."""
        return workflows.times(workflows.history(self.executions(), F.lit(now)))

    def detail(self, execution_id: str) -> DataFrame:
        """An execution's configuration and its tasks' latest status."""
        own = self.executions().where(F.col("id") == execution_id)
        config = own.join(self.versions().select("workflow_id", "version", "config"), ["workflow_id", "version"])
        return workflows.detail(config, workflows.latest_status(self._table("task", self.TASK).where(F.col("execution_id") == execution_id)))
