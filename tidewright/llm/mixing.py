"""Mixing sources to target weights by cube-method balanced sampling (operator 3).

A source's target over its size is the number of times each of its documents is wanted: a whole number of repeats and
a fraction, the inclusion probability of one repeat more. The cube method turns the fractions into 0 or 1 and keeps,
within each source, both the number of documents and their total size: three fractional documents always allow a move
along the null space of these two constraints, in a direction drawn so that every probability is kept in expectation,
until one of them is 0 or 1 (the flight). Sources are dealt by a hash of the document into blocks of bounded size, each
of which leaves at most two fractional documents; those are dealt into fewer blocks, and so on, until one block a source
is left. Its last two documents land by giving up first the constraint on their number, then that on their size.

A null text has size 0 and a null source is a source of its own. Rows equal in id, source and text are numbered, so
that repeated rows spread over blocks. All draws are seeded by source, level and block: reruns agree. Rows without an
id are treated as any other. Extra columns are not carried by the decisions; ``mix`` keeps them: rows equal in id, source
and text share what is taken of them evenly, in order of a mark over all columns, so that each keeps its own columns.
"""

from __future__ import annotations

import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.columns import map_sorted_groups, with_arrow_columns
from tidewright.llm.shared import checkpoint, row_mark
from tidewright.llm.text import SPACE, count_words

#: Weights of the sources in order of code point, null last, repeating (fixed values).
WEIGHTS = (5, 2, 1)
#: Words of the mix over words of all sources, and the most that a document is repeated.
SHARE, MOST = Fraction(3, 2), 2
#: Documents of a block.
BLOCK = 4000
#: Sources up to which their table, which the driver has anyway, is sent to all tasks.
SENT_SOURCES = 50_000


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> dict[str | None, Fraction]:
    """Each source's words: shares of the whole by weight, none above ``most`` times its size, the excess shared anew."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
        open_ -= set(full)
    return out


def fly(p: list[float], size: list[int], rng: random.Random, land: bool = False) -> list[float]:
    """Move the probabilities ``p`` to 0 or 1, keeping their sum and their sum weighted by ``size``.

    At most two stay fractional, none where ``land`` is set.
    """
    p, active = list(p), []

    def settle(direction: list[float]) -> None:
        """Step from the active probabilities along or against the direction to the first wall, fairly."""
        ahead = min((1 - p[k]) / u if u > 0 else -p[k] / u for k, u in zip(active, direction, strict=True) if u)
        back = min(p[k] / u if u > 0 else (p[k] - 1) / u for k, u in zip(active, direction, strict=True) if u)
        step = ahead if rng.random() * (ahead + back) < back else -back
        for k, u in zip(active, direction, strict=True):
            x = p[k] + step * u
            p[k] = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
        active[:] = [k for k in active if 0 < p[k] < 1]

    for k, x in enumerate(p):
        if not 0 < x < 1:
            continue
        active.append(k)
        if len(active) == 3:
            a, b, c = (size[i] for i in active)
            settle([float(b - c), float(c - a), float(a - b)] if a != b or b != c else [1.0, -1.0, 0.0])
    if land and len(active) == 2:
        a, b = (size[i] for i in active)
        settle([float(b), float(-a)] if a or b else [1.0, -1.0])
    while land and active:
        settle([1.0] + [0.0] * (len(active) - 1))
    return p


def _flight(rows: DataFrame, level: int, land: bool, seed: int) -> DataFrame:
    """The flight of each (source, block), the documents in an order of hashes."""

    def run(group: pa.Table) -> pa.RecordBatch:
        key = f"{seed}/{level}/{group['group'][0].as_py()}/{group['block'][0].as_py()}"
        p = fly(group["p"].to_pylist(), group["size"].to_pylist(), random.Random(zlib.crc32(key.encode()) << 20 | len(group)), land)
        group = group.set_column(group.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))
        return group.combine_chunks().to_batches()[0]

    schema = rows.select("id", "source", "size", "hash", "k", "p", "group", "block", "order").schema
    moved = map_sorted_groups(rows.select(*schema.names), ["group", "block"], run, schema.simpleString()[7:-1].replace(":", " "), ("order", "id", "hash", "k"))
    return moved.select("id", "source", "size", "hash", "k", "p", "group")


def _blocked(rows: DataFrame, counts: DataFrame, level: int) -> DataFrame:
    order = F.xxhash64("id", "hash", "k", F.lit(level))
    rows = rows.join(counts, "group").withColumn("order", order)
    return rows.withColumn("block", F.pmod("order", F.ceil(F.col("n") / BLOCK)))


def mix_decisions(
    docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", seed: int = 0,
) -> DataFrame:
    """(id, source, hash, k, size, source_size, target, repeats, taken) of every row; ``hash`` is the text's, ``k``
    numbers rows equal in id, source and text."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"))
    docs = docs.withColumn("hash", F.xxhash64("text"))
    docs = with_arrow_columns(docs, lambda b: {"size": pa.array(count_words(b["text"], ~SPACE).astype(np.int64))}, "size long", ("text",))
    rows = docs.groupBy("id", "source", "hash", "size").agg(F.count("*").alias("m"))
    rows = checkpoint(rows.withColumn("group", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))))
    totals = {
        r["source"]: (r["words"], r["n"])
        for r in rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("words"), F.sum("m").alias("n")).collect()
    }
    spark = docs.sparkSession
    wanted = targets({s: w for s, (w, _) in totals.items()})
    table = []
    for s, (words, n) in totals.items():
        ratio = wanted[s] / words if words else Fraction(0)
        table.append(("n" if s is None else f"s{s}", words, float(wanted[s]), int(ratio), float(ratio - int(ratio)), n))
    plan = spark.createDataFrame(table, "group string, source_size long, target double, whole int, fraction double, n long")
    plan = F.broadcast(plan) if len(table) <= SENT_SOURCES else plan
    units = rows.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "m"))).drop("m")
    units = units.join(plan.select("group", F.col("fraction").alias("p")), "group").select("id", "source", "size", "hash", "k", "p", "group")
    counts, level, done = plan.select("group", "n"), 0, []
    largest = max([n for _, n in totals.values()], default=0)
    while True:
        last = largest <= BLOCK
        state = checkpoint(_flight(_blocked(units, counts, level), level, last, seed))
        if last:
            done.append(state)
            break
        done.append(state.where("p = 0 OR p = 1"))
        units = state.where("p > 0 AND p < 1")
        counts = checkpoint(units.groupBy("group").agg(F.count("*").alias("n")))
        counts = F.broadcast(counts) if len(table) <= SENT_SOURCES else counts
        largest = counts.agg(F.max("n")).first()[0] or 0
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    out = out.join(plan.drop("n", "fraction"), "group").withColumn("repeats", F.col("whole") + F.col("p").cast("int"))
    return out.select("id", "source", "hash", "k", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of ``docs``, joined with the decisions once."""
    units = mix_decisions(docs, text, source, id_col, seed).groupBy("id", "source", "hash")
    units = units.agg(F.sum("repeats").alias("repeats"), F.count("*").alias("rows")).where("repeats > 0")
    units = units.select(row_mark("id", "source", "hash").alias("its"), "repeats", "rows")
    mine = docs.select(
        F.struct(*docs.columns).alias("row"), row_mark(*docs.columns).alias("mark"),
        F.col(id_col).alias("id"), F.col(source).alias("source"), F.xxhash64(text).alias("hash"),
    )
    kept = mine.select("row", "mark", row_mark("id", "source", "hash").alias("its")).join(units, "its")
    equal = kept.where("rows > 1").withColumn("place", F.row_number().over(Window.partitionBy("its").orderBy("mark")))
    own = F.floor(F.col("repeats") / F.col("rows")) + (F.col("place") <= F.col("repeats") % F.col("rows")).cast("int")
    taken = kept.where("rows = 1").select("row", "repeats").union(equal.select("row", own.alias("repeats")).where("repeats > 0"))
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).select("row.*")
