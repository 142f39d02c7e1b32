"""Near-duplicate embeddings by E8 lattice hashing (operator 10).

In each table a seeded Gaussian map takes a unit vector to blocks of eight coordinates, and each block is decoded to
its nearest point of the E8 lattice; the points name the vector's cell. A vector also visits the neighbouring cells
that it lies nearest to, one block moved by one of the 240 shortest lattice vectors. Two vectors are compared where one
lives and the other lives or visits, by their cosine in double precision, once: in the first table in which they meet.

Only cells in which vectors meet get the vectors themselves. A cell of many is cut into pieces, and each
pair of pieces is compared on its own by a matrix product, which yields each vector's number of links and a
spanning forest of the links, never the pairs. Equal vectors are one class with a count, so copies cost one row.

Vectors that are null, zero, empty or hold null or non-finite components link with nothing; vectors of different
lengths do not link. Repeated ids are kept, each row with the links of its own vector. Rows without an id take part
in the links of others but get no component. Extra columns are not carried.

The more vectors there are, the finer the cells and the more the tables (``SETTINGS``), so that a vector is compared with
a bounded number of unrelated ones, and two of cosine 0.9 still meet with probability 0.98, closer ones more often.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.shared import attach, checkpoint, connected_components, spanning_roots
from tidewright.llm.text import U64, mix

#: Neighbouring cells that a vector visits.
PROBES = 4
#: (distinct vectors up to which it holds, E8 blocks, lattice step, tables). The step is measured in the mapped space, where
#: each coordinate of a unit vector is standard normal. Measured chance that two vectors meet in one table, at cosine 0.9
#: and at random: 0.32 and 2.3e-4; 0.20 and 2.4e-5; 0.088 and 1.6e-6; 0.044 and some 1.6e-7; 0.032 and less.
SETTINGS = (
    (2_500, 2, 2.0, 12), (100_000, 2, 1.7, 19), (800_000, 2, 1.4, 44), (5_000_000, 3, 1.7, 90), (None, 4, 2.0, 122),
)
MIN_COSINE = 0.9
#: Members of a cell that are compared with each other at a time.
PIECE = 1024
#: Members up to which a group's pairs are compared one by one, and rows that are compared in one go.
SMALL, ROWS = 48, 20_000


@lru_cache(maxsize=1)
def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or all of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _even_sum(x: np.ndarray) -> np.ndarray:
    """Nearest integer points of even coordinate sum: round, then turn the worst coordinate where the sum is odd."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2)
    error = x[odd] - r[odd]
    worst = np.abs(error).argmax(1)
    r[odd, worst] += np.where(error[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the nearer of the even-sum integers and the same moved by a half."""
    whole, half = _even_sum(x), _even_sum(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


def setting(vectors: int) -> tuple[int, float, int]:
    """Blocks, step and tables for a number of distinct vectors."""
    return next((blocks, step, tables) for most, blocks, step, tables in SETTINGS if most is None or vectors <= most)


def _block_names(points: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of rows of lattice points of one block."""
    with np.errstate(over="ignore"):
        out = np.full(len(points), seed * 0x9E3779B9 + 1, U64)
        for column in np.rint(2 * points).astype(np.int64).view(U64).T:
            out = mix(out * U64(0xC2B2AE3D27D4EB4F) + column)
    return out


def _cell(parts: list[np.ndarray], table: int, size: int) -> np.ndarray:
    """Names of cells from those of their blocks: 55 bits of hash, 8 of the table, and a last bit left 0."""
    with np.errstate(over="ignore"):
        out = mix(sum(parts[1:], parts[0]) + U64(size * 0x85EBCA6B))
    return ((out >> U64(9) << U64(9)) | U64(table << 1)).view(np.int64)


@lru_cache(maxsize=64)
def _maps(size: int, blocks: int, tables: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([size, 8])).normal(size=(tables, size, 8 * blocks))


def cells(unit: np.ndarray, tables: int, blocks: int, probes: int, step: float) -> np.ndarray:
    """(vectors, tables, 1 + probes): each vector's own cell and those it visits."""
    n, size = unit.shape
    out = np.empty((n, tables, 1 + probes), np.int64)
    short = shortest_vectors()
    row = np.arange(n)[:, None]
    for t, projection in enumerate(_maps(size, blocks, tables)):
        x = unit @ projection / step
        parts = [decode(x[:, 8 * b : 8 * b + 8]) for b in range(blocks)]
        names = [_block_names(p, b) for b, p in enumerate(parts)]
        out[:, t, 0] = _cell(names, t, size)
        gain = np.concatenate([(x[:, 8 * b : 8 * b + 8] - parts[b]) @ short.T for b in range(blocks)], 1)
        best = np.argpartition(-gain, probes - 1, axis=1)[:, :probes]
        best = np.take_along_axis(best, np.lexsort((best, -gain[row, best]), axis=1), 1)
        for k in range(probes):
            block, which = best[:, k] // len(short), best[:, k] % len(short)
            moved = list(names)
            for b in range(blocks):
                at = np.flatnonzero(block == b)
                moved[b] = names[b].copy()
                moved[b][at] = _block_names(parts[b][at] + short[which[at]], b)
            out[:, t, 1 + k] = _cell(moved, t, size)
    return out


def _candidates(x: np.ndarray, group: np.ndarray, min_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i < j of one group whose cosine reaches the limit. Groups lie together; large ones go by a matrix product."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(starts, append=len(group))
    out = []
    small = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    for k in range(1, int(sizes[sizes <= SMALL].max(initial=0))):
        i = small[small + k < len(group)]
        i = i[group[i] == group[i + k]]
        for part in np.split(i, range(20_000, len(i), 20_000)):
            hit = np.einsum("ij,ij->i", x[part], x[part + k]) >= min_cosine
            out.append((part[hit], part[hit] + k))
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        u = x[start : start + size]
        i, j = np.nonzero(np.triu(u @ u.T >= min_cosine, 1))
        out.append((i + start, j + start))
    if not out:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", min_cosine: float = MIN_COSINE,
    probes: int = PROBES, blocks: int | None = None, step: float | None = None, tables: int | None = None,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row. Blocks, step and tables go by the counted vectors unless given."""
    kind = vectors.schema[vector].dataType.simpleString()
    held = F.col(vector) if kind == "array<float>" else F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), held.alias("v"))
    rows = rows.withColumn("class", F.xxhash64(F.col("v").cast("array<double>")))
    ok = F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = rows.where(F.coalesce(ok, F.lit(False)))
    named = valid.groupBy("class").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("id").alias("least"))
    classes = checkpoint(named)
    its = setting(classes.count())
    blocks, step, tables = (x or y for x, y in zip((blocks, step, tables), its, strict=True))
    if tables > 256:
        raise ValueError("at most 256 tables")

    def unit(column: pa.Array) -> np.ndarray:
        """The vectors scaled to unit length, shorter ones filled up by zeros."""
        size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        x = np.zeros((len(size), size.max(initial=0)))
        x[np.arange(x.shape[1]) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        x = x / np.abs(x).max(1)[:, None]
        return x / np.sqrt((x * x).sum(1))[:, None]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch["v"]).to_numpy(zero_copy_only=False)
            for size in np.unique(lengths):
                part = batch.filter(pa.array(lengths == size))
                name = cells(unit(part["v"]), tables, blocks, probes, step)
                # The last bit of a name tells the vector's own cell.
                name[:, :, 0] |= 1
                owner = np.repeat(part["class"].to_numpy(), tables * (1 + probes))
                yield pa.RecordBatch.from_arrays([pa.array(name.ravel()), pa.array(owner)], ["name", "class"])

    dealt = checkpoint(classes.select("class", "v").mapInArrow(deal, "name long, class long"))
    dealt = dealt.select(F.shiftright("name", 1).alias("cell"), (F.col("name") % 2 != 0).alias("own"), "class")
    met = dealt.groupBy("cell").agg(F.count("*").alias("size"), F.max("own").alias("lived")).where("size > 1 AND lived")
    pieces = F.ceil(F.col("size") / PIECE).cast("int")
    places = (
        dealt.join(met.select("cell", "size"), "cell").withColumn("piece", F.pmod(F.xxhash64("class"), pieces).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .select("cell", "class", "own", "piece", F.least("piece", "other").alias("p"), F.greatest("piece", "other").alias("q"))
    )
    members = places.join(classes, "class")

    def compare(rows: pa.Table) -> pa.RecordBatch | None:
        """Links of the groups in ``rows``: per member with any, its links' copies and the root of its spanning tree."""
        name, cell, p, q, piece, copies = (rows[k].to_numpy() for k in ("class", "cell", "p", "q", "piece", "copies"))
        own = np.array(rows["own"].to_pylist(), bool)
        new = (cell[1:] != cell[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        vectors = rows["v"].combine_chunks()
        x = unit(vectors)
        i, j = _candidates(x, np.concatenate([[0], np.cumsum(new)]), min_cosine)
        fits = (own[i] | own[j]) & ((p[i] == q[i]) | (piece[i] != piece[j]))
        i, j = i[fits], j[fits]
        if not len(i):
            return None
        some, place = np.unique(name, return_index=True)
        place = place[np.isin(some, name[np.concatenate([i, j])])]
        some = name[place]
        size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)[place]
        known = np.empty((len(place), tables, 1 + probes), np.int64)
        for d in np.unique(size):
            known[size == d] = cells(x[place][size == d, :d], tables, blocks, probes, step)
        first = np.ones(len(i), bool)
        for k in range(0, len(i), 50_000):
            part = slice(k, k + 50_000)
            a, b = known[np.searchsorted(some, name[i[part]])], known[np.searchsorted(some, name[j[part]])]
            b_visits, a_visits = (a[:, :, :1] == b).any(2), (b[:, :, :1] == a).any(2)
            at = (b_visits | a_visits).argmax(1)
            row = np.arange(len(at))
            home, away = a[row, at, 0], b[row, at, 0]
            met = np.where(b_visits[row, at], home, away)
            met = np.where(b_visits[row, at] & a_visits[row, at], np.minimum(home, away), met)
            first[part] = met >> 1 == cell[i[part]]
        i, j = i[first], j[first]
        if not len(i):
            return None
        n = np.bincount(i, copies[j], len(name)) + np.bincount(j, copies[i], len(name))
        root = name[spanning_roots(len(name), i, j)]
        linked = n > 0
        return pa.RecordBatch.from_arrays(
            [pa.array(name[linked]), pa.array(root[linked]), pa.array(n[linked].astype(np.int64))], ["class", "root", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if sum(map(len, held)) >= ROWS:
                key = [(batch[k][0].as_py()) for k in ("cell", "p", "q")]
                rows = pa.Table.from_batches(held)
                same = np.all([rows[k].to_numpy() == x for k, x in zip(("cell", "p", "q"), key, strict=True)], axis=0)
                cut = len(rows) - int(same.sum())
                if cut and (made := compare(rows.slice(0, cut))) is not None:
                    yield made
                held = rows.slice(cut).to_batches()
            held.append(batch)
        if held and (made := compare(pa.Table.from_batches(held))) is not None:
            yield made

    members = members.select("cell", "p", "q", "class", "own", "piece", "v", "copies")
    members = members.repartition("cell", "p", "q").sortWithinPartitions("cell", "p", "q")
    found = checkpoint(members.mapInArrow(run, "class long, root long, n long"))
    parts = connected_components(found.selectExpr("class AS a", "root AS b")).withColumnRenamed("node", "class")
    counts = found.groupBy("class").agg(F.sum("n").alias("n"))
    near = checkpoint(parts.join(classes.select("class", "least"), "class"))
    whole = checkpoint(near.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("copies")))
    near = attach(near, whole, "component", near.count()).select("class", "component_id")
    facts = classes.select("class", "copies", "least").join(counts, "class", "left").join(near, "class", "left")
    n_links = (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    facts = checkpoint(facts.select("class", "copies", n_links, F.coalesce("component_id", "least").alias("component_id")))
    own = attach(valid.select("id", "class"), facts, "class", valid.count())
    linked = own.select("id", "n_links", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    alone = rows.where(~F.coalesce(ok, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
