"""Session factory and table loading shared by queries, tests and the bench."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def local_session(cpus: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with adaptive execution; on a cluster the submitter's session is used instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidewright")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the store that the driver and all executors share; a temporary one only in a local session."""
    context = spark.sparkContext
    shared = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="tidewright-")
    return f"{shared.rstrip('/')}/{uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
