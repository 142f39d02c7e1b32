"""A key-value store of blobs on partitioned Parquet, with metadata, checksums, codec choice and statistics.

Values lie in ``data/bucket=NNN`` by a hash of the key; each put appends, and the newest row of a key counts. Batches of
puts are one write. ``get`` prunes to the key's bucket and pushes the key down to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import bytes as B
from tidewright.operators import codecs

BUCKETS = 256
SCHEMA = "key string, codec string, blob binary, original_size long, compressed_size long, checksum long, version long, bucket int"


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    """The directory number of a key."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def file_name(key: Column) -> Column:
    """A key as a file name: slashes become underscores."""
    return F.translate(key, "/\\", "__")


class KeyValueStore:
    """``put``, ``get``, ``list_keys``, ``metadata`` and ``statistics`` of one store."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def put(self, rows: DataFrame, version: int, codec: str = "auto") -> None:
        """Store each (key, value) under a version; ``auto`` chooses a codec for each value by its shape."""
        if codec == "auto":
            shape = codecs.features(rows).withColumn("codec", codecs.choose(*map(F.col, ("size", "series", "byte_count", "gram_count"))))
            named = shape.select("key", "value", "codec")
        else:
            named = rows.select("key", "value", F.lit(codec).alias("codec"))
        made = named.withColumn("blob", B.encode(F.col("codec"), F.col("value"))).select(
            "key", "codec", "blob", F.octet_length("value").cast("long").alias("original_size"), F.octet_length("blob").cast("long").alias("compressed_size"),
            B.checksum(F.col("value")).alias("checksum"), F.lit(version).cast("long").alias("version"), bucket_of(F.col("key")).alias("bucket"),
        )
        made.repartition("bucket").sortWithinPartitions("bucket", "key").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/data")

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in ("key", "version")]
        last = rows.groupBy("key").agg(F.max_by(F.struct(*rest), "version").alias("r"), F.max("version").alias("version"))
        return last.select("key", "r.*", "version")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/data")

    def get(self, *keys: str) -> DataFrame:
        """(key, value, intact) of the keys that are there; ``intact`` tells whether the checksum holds."""
        number = F.array(*[bucket_of(F.lit(k)) for k in keys])
        buckets = [x for (x,) in self.spark.range(1).select(F.explode(number)).distinct().collect()]
        return self._opened(self._rows().where(F.col("bucket").isin(buckets) & F.col("key").isin(list(keys))))

    def values(self) -> DataFrame:
        """(key, value, intact) of all keys."""
        return self._opened(self._rows())

    def _opened(self, rows: DataFrame) -> DataFrame:
        value = self._newest(rows).withColumn("value", B.decode(F.col("codec"), F.col("blob")))
        return value.select("key", "value", (B.checksum(F.col("value")) == F.col("checksum")).alias("intact"))

    def list_keys(self, prefix: str = "") -> DataFrame:
        """The distinct keys with a prefix."""
        return self._rows().where(F.col("key").startswith(prefix)).select("key").distinct()

    def metadata(self) -> DataFrame:
        """The newest row of each key without its blob."""
        rows = self._rows().drop("blob")
        rest = [c for c in rows.columns if c not in ("key", "version")]
        last = rows.groupBy("key").agg(F.max_by(F.struct(*rest), "version").alias("r"), F.max("version").alias("version"))
        return last.select("key", "r.*", "version").withColumn("filename", file_name(F.col("key")))

    def statistics(self) -> DataFrame:
        """Puts, bytes and ratio of each codec over the live keys."""
        return codecs.statistics(self.metadata())
