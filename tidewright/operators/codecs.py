"""Encoding analysis as queries: deltas, runs, n-grams, codec choice, statistics and cache eviction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import bytes as B

#: Sizes below which a blob is stored raw, by snappy, by lz4.
TINY, SMALL, MEDIUM = 100, 1024, 10 * 1024
SERIES_ITEMS, SERIES_LIMIT = 13, 10**15
SAMPLE_BYTES, MIN_GRAM_COUNT, MIN_BYTE_COUNT = 1000, 10, 500
#: Count from which one byte prevails so far that runs are long, whatever else the data look like.
PREVAILING = 800
#: Bytes of text whose n-grams are counted at a time.
GRAM_BYTES = 2 << 20


def delta_encode(points: DataFrame) -> DataFrame:
    """Each series' values as differences from the one before, the first as it is, with their zig-zag varint sizes."""
    step = F.col("v") - F.lag("v", 1, 0).over(Window.partitionBy("series").orderBy("i"))
    folded = F.when(F.col("d") >= 0, F.col("d") * 2).otherwise(-F.col("d") * 2 - 1)
    return points.withColumn("d", step).withColumn("n_bytes", varint_size(folded)).select("series", "i", "d", "n_bytes")


def varint_size(value: Column) -> Column:
    """Bytes of a non-negative integer in groups of seven bits."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / 7)).cast("int")


def delta_decode(steps: DataFrame) -> DataFrame:
    """The values again, as running sums."""
    so_far = Window.partitionBy("series").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("series", "i", F.sum("d").over(so_far).alias("v"))


def run_length_encode(points: DataFrame) -> DataFrame:
    """Runs of equal consecutive values of each series: (series, run, value, start, n)."""
    order = Window.partitionBy("series").orderBy("i")
    new = (~F.col("v").eqNullSafe(F.lag("v").over(order))) | (F.row_number().over(order) == 1)
    marked = points.withColumn("run", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("series", "run").agg(F.first("v").alias("value"), F.min("i").alias("start"), F.count("*").alias("n"))


def run_length_decode(runs: DataFrame) -> DataFrame:
    """One row for each place of each run again."""
    return runs.select("series", "run", "value", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("k"))


def top_values(runs: DataFrame, n: int = 8) -> DataFrame:
    """The most frequent values over all runs; ties by value."""
    return runs.groupBy("value").agg(F.sum("n").alias("freq")).orderBy(F.desc("freq"), "value").limit(n)


def ngrams(texts: DataFrame, n: int, least: int = 3) -> DataFrame:
    """Character n-grams that occur at least ``least`` times in all texts (id, text); null texts have none.

    Each Arrow batch is counted in runs of bytes, so that a run's grams, not its places, are summed by key, and the time
    does not depend on how long a text is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grams, counts in _count_grams(batch.column(0).drop_null(), n):
                yield pa.RecordBatch.from_arrays([grams, counts], ["gram", "freq"])

    grams = texts.select("text").mapInArrow(run, "gram string, freq long")
    return grams.groupBy("gram").agg(F.sum("freq").alias("freq")).where(F.col("freq") >= least)


def _count_grams(texts: pa.Array, n: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The n-grams of runs of ``GRAM_BYTES`` of the texts and their counts; a gram belongs to the run in which it starts."""
    texts = texts.cast(pa.large_string())
    _, places, data = texts.buffers()
    ends = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    first, stop = int(ends[0]), int(ends[-1])
    whole = np.frombuffer(data, np.uint8)[first:stop] if stop > first else np.empty(0, np.uint8)
    ends = ends[1:] - first
    for start in range(0, len(whole), GRAM_BYTES):
        # The grams that start last reach n - 1 characters, of up to four bytes, into the next run.
        part = whole[start : start + GRAM_BYTES + 4 * n]
        at = np.flatnonzero(part & 0xC0 != 0x80)
        if start + len(part) < len(whole):
            at, part = at[:-1], part[: at[-1]]
        if not len(at):
            continue
        letters = np.frombuffer(part[at[0] :].tobytes().decode().encode("utf-32-le"), "<u4")
        fits = np.zeros(len(at), bool)
        fits[: min(int(np.searchsorted(at, GRAM_BYTES)), max(0, len(at) - n + 1))] = True
        near = ends[np.searchsorted(ends, start, "left") : np.searchsorted(ends, start + len(part), "right")]
        over = np.searchsorted(at, near - start)[:, None] - np.arange(1, n)
        fits[over[over >= 0]] = False
        if not fits.any():
            continue
        chars, counts = _unique_grams(letters, fits, n)
        wide = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000).astype(np.int32)
        offsets = np.concatenate([[0], np.cumsum(wide.sum(1))]).astype(np.int32)
        packed = chars.astype("<u4").tobytes().decode("utf-32-le").encode()
        yield pa.StringArray.from_buffers(len(chars), pa.py_buffer(offsets), pa.py_buffer(packed)), pa.array(counts)


def _unique_grams(letters: np.ndarray, fits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams that start at the places that fit, one a row, and their counts; each gram is told by one number."""
    alphabet = np.unique(letters)
    rank = np.zeros(int(alphabet[-1]) + 1, np.int64)
    rank[alphabet] = np.arange(len(alphabet))
    letters, at = rank[letters], np.flatnonzero(fits)
    key, span, base, packed = letters[at], len(alphabet), len(alphabet), {}
    for k in range(1, n):
        if span * base >= 1 << 63:
            # Beyond 63 bits the beginnings that occur are numbered anew.
            packed[k], key = np.unique(key, return_inverse=True)
            span = len(packed[k])
        key, span = key * base + letters[at + k], span * base
    left, counts = np.unique(key, return_counts=True)
    chars = np.empty((len(left), n), np.uint32)
    for k in range(n - 1, 0, -1):
        chars[:, k] = alphabet[left % base]
        left = left // base
        left = packed[k][left] if k in packed else left
    chars[:, 0] = alphabet[left]
    return chars, counts.astype(np.int64)


def features(blobs: DataFrame) -> DataFrame:
    """Per blob (key, value binary): size, whether it reads as a series of 64-bit integers, and the counts of the most
    frequent byte and 4-gram in its first 1000 bytes. One Arrow pass, a row at a time in memory."""

    def measure(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            v = bytes(v or b"")
            head = np.frombuffer(v, np.uint8, min(len(v), SAMPLE_BYTES))
            whole = np.frombuffer(v, "<i8", min(SERIES_ITEMS, len(v) // 8))
            series = len(whole) == SERIES_ITEMS and bool((np.abs(whole.astype(float)) <= SERIES_LIMIT).all())
            top = int(np.bincount(head, minlength=256).max())
            wide = head.astype(np.uint32)
            grams = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24 if len(head) > 3 else wide[:0]
            gram = int(np.unique(grams, return_counts=True)[1].max()) if len(grams) else 0
            out.append((len(v), series, top, gram))
        return pd.DataFrame(out, columns=["size", "series", "byte_count", "gram_count"])

    shape = F.pandas_udf(measure, "size long, series boolean, byte_count long, gram_count long")
    return blobs.withColumn("f", shape("value")).select("key", "value", "f.*")


def choose(size: Column, series: Column, byte_count: Column, gram_count: Column) -> Column:
    """The codec for a blob: by size while small; then run-length if one byte prevails, delta for a series, dictionary,
    run-length for a frequent byte, else zstd.

    Data of one prevailing byte also look like a series and like recurring n-grams, so they are told first; a series of
    small numbers has many zero bytes, so a merely frequent byte is told last.
    """
    return (
        F.when(size < TINY, "none").when(size < SMALL, "snappy").when(size < MEDIUM, "lz4")
        .when(byte_count > PREVAILING, "rle").when(series, "delta").when(gram_count > MIN_GRAM_COUNT, "dictionary")
        .when(byte_count > MIN_BYTE_COUNT, "rle").otherwise("zstd")
    )


def choose_by_size(size: Column) -> Column:
    """The part of the choice that size alone decides."""
    return F.when(size < TINY, "none").when(size < SMALL, "snappy").when(size < MEDIUM, "lz4").otherwise("by_content")


def statistics(meta: DataFrame) -> DataFrame:
    """Per codec: blobs, bytes before and after, and their ratio, 1 where nothing is stored."""
    return meta.groupBy("codec").agg(
        F.count("*").alias("puts"), F.sum("original_size").alias("original"), F.sum("compressed_size").alias("compressed"),
        F.coalesce(F.sum("original_size") / F.nullif(F.sum("compressed_size"), F.lit(0)), F.lit(1.0)).alias("ratio"),
    )


def matrix(blobs: DataFrame, codecs: tuple[str, ...] = tuple(B.CODECS)) -> DataFrame:
    """Each blob (key, shape, value) by each codec: sizes, ratio and whether it decodes to itself."""
    each = blobs.withColumn("codec", F.explode(F.array(*map(F.lit, codecs))))
    made = each.withColumn("blob", B.encode(F.col("codec"), F.col("value")))
    same = B.decode(F.col("codec"), F.col("blob")) == F.col("value")
    sizes = made.select("key", "shape", "codec", F.octet_length("value").alias("original_size"), F.octet_length("blob").alias("compressed_size"), same.alias("intact"))
    return sizes.withColumn("ratio", F.col("original_size") / F.col("compressed_size"))


def best_codec(results: DataFrame) -> DataFrame:
    """Each shape's codec of the greatest mean ratio; ties by name."""
    means = results.groupBy("shape", "codec").agg(F.avg("ratio").alias("ratio"))
    best = means.groupBy("shape").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "codec")).alias("b"))
    return best.select("shape", F.col("b.codec").alias("codec"), (-F.col("b.r")).alias("ratio"))


def eviction(items: DataFrame, capacity: int, shards: int = 256) -> DataFrame:
    """Which items (key, size, at) a least-recently-used cache of ``capacity`` bytes has dropped.

    An item is gone if it and all newer ones exceed the capacity. The running sum is taken within ranges of ``at``
    and moved on by the ranges' totals, so that no task sorts the whole table.
    """
    spark = items.sparkSession
    bounds = [r[0] for r in items.select(F.explode(F.approx_percentile("at", [i / shards for i in range(1, shards)]))).distinct().orderBy("col").collect()]
    shard = F.lit(len(bounds)) - sum([(F.col("at") > F.lit(b)).cast("int") for b in bounds], F.lit(0)) if bounds else F.lit(0)
    dealt = items.withColumn("shard", shard)
    totals = {r["shard"]: r["s"] for r in dealt.groupBy("shard").agg(F.sum("size").alias("s")).collect()}
    before, rows = 0, []
    for k in sorted(totals):
        rows.append((k, before))
        before += totals[k]
    moved = spark.createDataFrame(rows or [(0, 0)], "shard int, before long")
    newest = Window.partitionBy("shard").orderBy(F.desc("at"), F.desc("key")).rowsBetween(Window.unboundedPreceding, 0)
    running = dealt.join(F.broadcast(moved), "shard").withColumn("newer", F.sum("size").over(newest) + F.col("before"))
    return running.select("key", "size", "at", "newer", (F.col("newer") > capacity).alias("evicted"))
