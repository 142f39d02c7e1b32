"""Adding columns to a DataFrame by Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def release_memory() -> None:
    """Give freed memory back to the system at the end of a task: its worker lives on beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def with_arrow_columns(
    df: DataFrame, f: Callable[[pa.RecordBatch], dict[str, pa.Array]], added: str, drop: tuple[str, ...] = ()
) -> DataFrame:
    """``df`` without ``drop``, with the ``added`` columns that ``f`` makes of each batch.

    An added column takes the place of one of the same name, whatever its case.
    """
    new = T.StructType.fromDDL(added)
    gone = {x.lower() for x in (*new.names, *drop)}
    kept = [x for x in df.schema.fields if x.name.lower() not in gone]
    schema = T.StructType([*kept, *new.fields])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            made = f(batch)
            columns = [batch.column(batch.schema.get_field_index(x.name)) for x in kept]
            yield pa.RecordBatch.from_arrays([*columns, *(made[x] for x in new.names)], schema.names)
        release_memory()

    return df.mapInArrow(batches, schema)


def map_sorted_groups(
    df: DataFrame, keys: list[str], f: Callable[[pa.Table], pa.RecordBatch | None], schema: str, order: tuple[str, ...] = ()
) -> DataFrame:
    """``f`` of the rows of each key, dealt out by key and sorted by ``order`` within a key.

    A group is held in memory whole, so callers bound the size of a group by their choice of keys.
    """
    names = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        out: list[pa.RecordBatch] = []

        def close() -> None:
            made = f(pa.Table.from_batches(held)) if held else None
            if made is not None and len(made):
                out.append(made.select(names))

        for batch in batches:
            columns = [batch[k].to_pylist() for k in keys]
            start = 0
            for i, key in enumerate(zip(*columns, strict=True)):
                if key != last:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    close()
                    held.clear()
                    last, start = key, i
            if len(batch) > start:
                held.append(batch.slice(start))
            if sum(map(len, out)) > 1000:
                yield from out
                out.clear()
        close()
        yield from out
        release_memory()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
